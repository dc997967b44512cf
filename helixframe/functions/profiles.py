"""Names, codes, radii and thresholds, and the representations built on them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that count as solvent.
SOLVENT = ("HOH",)

# One-letter codes of residues and nucleotides.
LETTERS = {
    "ILE": "I", "GLN": "Q", "GLX": "Z", "GLY": "G", "GLU": "E", "CYS": "C", "HIS": "H", "SER": "S", "LYS": "K", "PRO": "P",
    "ASX": "B", "ASN": "N", "VAL": "V", "THR": "T", "ASP": "D", "TRP": "W", "PHE": "F", "ALA": "A", "MET": "M", "LEU": "L",
    "ARG": "R", "TYR": "Y", "G": "G", "C": "C", "U": "U", "A": "A", "DG": "G", "DA": "A", "DT": "T", "DC": "C",
}
# One-letter codes of modified residues.
MODIFIED = {
    "DNP": "A", "ABI": "A", "ALM": "A", "MAA": "A", "TIH": "A", "FLA": "A", "DAL": "A", "CSD": "A", "BNN": "A", "HAC": "A",
    "PRR": "A", "AYA": "A", "CHG": "A", "DHA": "A", "TPQ": "A", "SEG": "A", "DIV": "V", "MVA": "V", "DVA": "V", "BUG": "L",
    "DLE": "L", "CLE": "L", "NLN": "L", "NLE": "L", "NLP": "L", "MLE": "L", "LEF": "L", "DIL": "I", "IIL": "I", "DPR": "P",
    "HYP": "P", "MSE": "M", "OMT": "M", "CXM": "M", "FME": "M", "MME": "M", "DAH": "F", "PHI": "F", "DPN": "F", "HPQ": "F",
    "PHL": "F", "LTR": "W", "TPL": "W", "DTR": "W", "TRO": "W", "HTR": "W", "MSA": "G", "SAR": "G", "MPQ": "G", "GLZ": "G",
    "GSC": "G", "GL3": "G", "NMC": "G", "DSN": "S", "SEL": "S", "SEP": "S", "SET": "S", "SAC": "S", "SVA": "S", "MIS": "S",
    "OAS": "S", "TPO": "T", "ALO": "T", "DTH": "T", "BMT": "T", "BCS": "C", "SOC": "C", "C5C": "C", "C6C": "C", "SCS": "C",
    "PEC": "C", "DCY": "C", "EFC": "C", "SCY": "C", "SMC": "C", "CSX": "C", "BUC": "C", "CSO": "C", "PR3": "C", "CCS": "C",
    "CEA": "C", "CME": "C", "CSP": "C", "CSS": "C", "CSW": "C", "CY1": "C", "CY3": "C", "CYG": "C", "CYM": "C", "CYQ": "C",
    "SCH": "C", "SHC": "C", "OCS": "C", "CAS": "C", "TYQ": "Y", "TYS": "Y", "TYB": "Y", "STY": "Y", "DTY": "Y", "IYR": "Y",
    "PAQ": "Y", "TYY": "Y", "PTR": "Y", "TYI": "Y", "MEN": "N", "DGN": "Q", "MGN": "Q", "2AS": "D", "ASB": "D", "DAS": "D",
    "ASK": "D", "ASL": "D", "ASQ": "D", "BHD": "D", "ASA": "D", "DSP": "D", "5HP": "E", "CGU": "E", "DGL": "E", "GMA": "E",
    "GGL": "E", "PCA": "E", "DLY": "K", "LYM": "K", "LLY": "K", "LYZ": "K", "KCX": "K", "LLP": "K", "TRG": "K", "SHR": "K",
    "ALY": "K", "ARM": "R", "ACL": "R", "HAR": "R", "HMR": "R", "AGM": "R", "DAR": "R", "HIC": "H", "3AH": "H", "NEM": "H",
    "NEP": "H", "DHI": "H", "MHS": "H", "HIP": "H",
}
UNKNOWN_LETTER = "?"

# Secondary structure labels in three classes.
SIMPLE_SS = {"H": "H", "B": "E", "E": "E", "G": "H", "I": "H", "T": "C", "S": "C", "-": "C", "=": "="}

# Ion radii in Angstrom by atom name, and the radius of any other.
RADII = {
    "BE": 0.59, "BA": 1.49, "BI": 1.17, "BK": 1.1, "BR": 1.82, "RU": 0.82, "RE": 0.77, "TM": 1.17, "RA": 1.62, "RB": 1.66,
    "RH": 0.805, "P": 0.58, "GE": 0.87, "GD": 1.078, "GA": 0.76, "OS": 0.77, "C": 0.3, "HO": 1.041, "HF": 0.85, "HG": 1.33,
    "PR": 1.13, "PT": 0.94, "PU": 1.14, "PB": 1.33, "PA": 1.16, "PD": 1.0, "PO": 1.08, "PM": 1.11, "ZN": 0.88, "K": 1.52,
    "O": 1.26, "S": 1.7, "W": 0.8, "EU": 1.31, "ZR": 0.86, "ER": 1.03, "MG": 0.86, "MO": 0.83, "MN": 0.97, "AU": 1.51,
    "FR": 1.94, "FE": 0.92, "NI": 0.83, "NA": 1.16, "NB": 0.86, "ND": 1.43, "ES": 0.928, "NP": 1.24, "B": 0.41, "CO": 0.885,
    "CM": 1.11, "CL": 1.67, "CA": 1.14, "CF": 1.09, "CE": 1.15, "N": 1.32, "V": 0.93, "CS": 1.81, "CR": 0.94, "CU": 0.91,
    "SR": 1.32, "SI": 0.54, "SN": 0.83, "SM": 1.36, "SC": 0.885, "SB": 0.9, "SE": 1.84, "YB": 1.16, "DY": 1.21, "LA": 1.172,
    "F": 1.19, "LI": 0.9, "TL": 1.64, "LU": 1.001, "TH": 1.08, "TI": 1.0, "TE": 2.07, "TB": 1.063, "TC": 0.785, "TA": 0.86,
    "AC": 1.26, "AG": 1.29, "I": 2.06, "IR": 0.82, "AM": 1.4, "AL": 0.675, "AS": 0.72, "U": 1.165, "AT": 0.76, "IN": 0.94,
    "Y": 1.04, "CD": 1.09, "XE": 0.62,
}
OTHER_RADIUS = 2.5


def code_map(codes: Mapping[str, object]) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


@dataclass(frozen=True)
class Profile:
    """One kind of mer: the atoms of its backbone, first to last, the points that stand for it, and how far apart the
    ends of two bonded neighbours may be. `points` maps names to functions of the atoms column."""

    type: str
    backbone: tuple[str, ...]
    indicators: tuple[str, ...]
    bond: float
    points: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)


RESIDUE = Profile("Residue", ("N", "CA", "C"), ("CA", "cbx"), 2.0)
NUCLEOTIDE = Profile("Nucleotide", ("P", "O5'", "C5'", "C4'", "C3'", "O3'"), ("C3'", "P", "ring_center"), 2.0)
CA_TRACE = Profile("CATrace", ("CA",), ("CA", "mpp"), 5.0)
P_TRACE = Profile("PTrace", ("P",), ("P",), 7.5)
MARTINI = Profile("MartiniResidue", ("BB",), ("BB", "last_sc"), 5.0)
FULL_ATOM = (RESIDUE, NUCLEOTIDE)

#: What each type is a kind of.
LINEAGE = {
    "Mer": ("Residue", "Nucleotide", "CATrace", "PTrace", "MartiniResidue"),
    "Ligand": ("MonoatomicIon", "Compound"),
    "Residue": ("Residue", "CATrace", "MartiniResidue"),
    "Nucleotide": ("Nucleotide", "PTrace"),
}
