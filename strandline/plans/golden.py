"""Small files with the counts that the parsing and ordering rules demand."""

from __future__ import annotations

#: (name, input, k, order, counts, classes): fixed values.
GOLDEN = [
    ("smoke", ">test\nACGTACGTACGT\n", 5, "reference", {"ACGTA": 4, "CGTAC": 4}, 2),
    ("lines join", ">a\nACG\nTAC\n", 4, "reference", {"ACGT": 1, "CGTA": 1, "GTAC": 1}, 3),
    ("carriage return breaks", ">a\r\nACG\r\nTAC\r\n", 3, "reference", {"ACG": 1, "GTA": 1}, 2),
    ("carriage return, no window", ">a\r\nACG\r\nTAC\r\n", 4, "reference", {}, 0),
    ("other letters break", ">a\nacgNNgtaUcca\n", 3, "reference", {"ACG": 1, "CCA": 1, "GTA": 1}, 3),
    ("header inside a line", ">a\nACG>TAC\nGTA\n", 3, "reference", {"ACG": 1, "GTA": 1}, 2),
    ("k above the length", ">a\nAC\n", 3, "reference", {}, 0),
    ("records apart", ">a\nAAC\n>b\nGGT\n", 3, "reference", {"AAC": 1, "ACC": 1}, 2),
    ("one base", ">a\nAACGTT\n", 1, "reference", {"A": 4, "C": 2}, 2),
    ("semicolon is no comment", ">a\n;cat\nACG\n", 3, "reference", {"ACG": 1, "ATA": 1, "ATG": 1, "GTA": 1}, 3),
    ("fastq", "@r1\nACGTN\n+\n@@III\n@r2\nTTACG\n+r2\nIIIII\n", 3, "reference", {"ACG": 3, "GTA": 1, "TAA": 1}, 3),
    ("fastq wrapped", "@r1\nACG\nTAC\n+\nIII\nIII\n@r2\nGGG\n+\nIII\n", 3, "reference", {"ACG": 1, "CCC": 1}, 2),
    ("fastq with junk", "@r1\nACG\n+\nIII\n\njunk\n@r2\nGGG\n+\nIII", 3, "reference", {"ACG": 1, "CCC": 1}, 2),
    ("fastq out of step", "@r1\nACG\nTAC\n+\n@II\nIII\n@r2\nGGG\n+\nIII\n", 3, "reference", {"ACG": 1}, 1),
    ("255 times", ">a\n" + "A" * 259, 5, "reference", {"AAAAA": 255}, 1),
    ("256 times", ">a\n" + "A" * 260, 5, "reference", {"AAAAA": 256}, 1),
    ("two blocks, reference order", ">a\nAGCGGAATCATCTCGAGTGGGATGCATCGTGTC\n", 33, "reference", {"GACACGATGCATCCCACTCGAGATGATTCCGCT": 1}, 1),
    ("two blocks, lexicographic", ">a\nAGCGGAATCATCTCGAGTGGGATGCATCGTGTC\n", 33, "lex", {"AGCGGAATCATCTCGAGTGGGATGCATCGTGTC": 1}, 1),
]
