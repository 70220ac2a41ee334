"""Residues: names, letters, properties, and substitution scores."""

from __future__ import annotations

# Three-letter names and letters of the twenty amino acids.
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
#: Modified residues read as the one they come from.
MODIFIED = {"MSE": "MET", "SEP": "SER"}
UNKNOWN = "UNKNOWN"
#: Side-chain classes; residues not named have none.
PROPERTIES = {
    "POSITIVE": ("ARG", "HIS", "LYS"),
    "NEGATIVE": ("ASP", "GLU"),
    "POLAR": ("SER", "THR", "ASN", "GLN"),
    "HYDROPHOBIC": ("ALA", "VAL", "ILE", "LEU", "MET", "PHE", "TYR", "TRP"),
}

# BLOSUM62 in half bits, as published; below the diagonal, and on it.
TRIANGLE = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
B -2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4
Z -1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4
X -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1
"""


def substitution_scores(triangle: str = TRIANGLE) -> dict[tuple[str, str], int]:
    """Scores by pair of letters, of a lower triangle; other tables may be passed in."""
    scores: dict[tuple[str, str], int] = {}
    order: list[str] = []
    for line in triangle.strip().splitlines():
        letter, *values = line.split()
        order.append(letter)
        for other, v in zip(order, values):
            scores[letter, other] = scores[other, letter] = int(v)
    return scores


#: IUPAC nucleotide codes, as the bases each stands for.
NUCLEOTIDES = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "M": "AC", "R": "AG", "S": "CG", "V": "ACG", "W": "AT", "Y": "CT", "H": "ACT", "K": "GT", "D": "AGT", "B": "CGT", "N": "ACGT"}
COMPLEMENT = ("ACGTUMRSVWYHKDBN", "TGCAAKYSBWRDMHVN")
