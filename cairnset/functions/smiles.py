"""SMILES text: canonical forms, likeness and well-formedness (no valence model)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.functions.text import MARKS, sort_components, squeeze

#: What is left of a SMILES once its bracket atoms and two-letter atoms are taken for C.
SMILES_SIGNS = r"^[BCNOPSFIbcnops*\-=#$:~/\\().0-9%]+$"


def reads_as_smiles(c: Column) -> Column:
    """Whether a value holds nothing but SMILES signs (its grammar is not checked)."""
    return F.regexp_replace(c, r"\[[^\[\]]+\]|Cl|Br", "C").rlike(SMILES_SIGNS)


def bare_structure(c: Column) -> Column:
    """A structure without blanks, invisible characters and the marks around it."""
    return F.btrim(squeeze(c), F.lit(MARKS))


def structure_key(c: Column) -> Column:
    """Equal for two spellings of one structure: blanks, marks around the whole, order of components and the case of
    the second letter of Cl and Br don't count; every other character does."""
    s = F.replace(F.replace(bare_structure(c), F.lit("CL"), F.lit("Cl")), F.lit("BR"), F.lit("Br"))
    return sort_components(s)


def longest_component(c: Column) -> Column:
    """The longest dot-separated component (ties: the first in sorted order); null for blank values."""
    parts = F.split(squeeze(c), r"\.", -1)
    best = F.array_sort(F.transform(parts, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))[0]["p"]
    return F.when(F.length(best) > 0, best)


def with_orientation(df: DataFrame, a: str, b: str, swapped: str = "swapped") -> DataFrame:
    """Adds ``<a>_key`` and ``<b>_key`` (:func:`structure_key`) and whether the two fields were exchanged.

    The field that reads as SMILES throughout is the structure; if both or neither do, the one with more
    bonds, branches and brackets is; at a tie the fields stand as given.
    """
    keyed = df.withColumns({f"{a}_key": structure_key(F.col(a)), f"{b}_key": structure_key(F.col(b))})
    signs = lambda c: F.length(F.regexp_replace(c, r"[^=#()\[\]]", ""))
    likes = keyed.withColumns({"_like_a": reads_as_smiles(F.col(f"{a}_key")), "_like_b": reads_as_smiles(F.col(f"{b}_key"))})
    swap = F.when(F.col("_like_a") != F.col("_like_b"), F.col("_like_b")).otherwise(signs(F.col(f"{b}_key")) > signs(F.col(f"{a}_key")))
    return likes.withColumn(swapped, swap).drop("_like_a", "_like_b")


#: Element symbols, the organic subset and aromatic symbols of the OpenSMILES grammar.
ELEMENTS = frozenset(
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo "
    "Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl "
    "Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og".split()
)
AROMATIC_BRACKET = frozenset("b c n o p s se as te si".split())

_TOKEN = re.compile(r"(\[[^\[\]]*\])|(Cl|Br|[BCNOPSFIbcnops*])|(%\d\d|%\(\d{1,5}\)|\d)|([-=#$:/\\~])|(\()|(\))|(\.)")
_BRACKET = re.compile(
    r"\[\d*([A-Z][a-z]?|[a-z]{1,2}|\*)(?:@(?:@|TH[12]|AL[12]|SP[1-3]|TB\d{1,2}|OH\d{1,2})?)?(?:H\d?)?(?:\+\+|--|[+-]\d{0,2})?(?::\d+)?\]"
)


def _bracket_ok(text: str) -> bool:
    m = _BRACKET.fullmatch(text)
    if not m:
        return False
    s = m[1]
    return s == "*" or s in ELEMENTS or s in AROMATIC_BRACKET


def well_formed(smiles: str) -> bool:
    """Whether a SMILES reads without error: brackets, branches and ring closures paired, known symbols only, an atom
    on each side of a bond, no empty component. Valences are not judged. A small helper for use inside tasks."""
    if not smiles:
        return False
    at, end, prev, rings, stack = 0, len(smiles), "start", {}, []
    while at < end:
        m = _TOKEN.match(smiles, at)
        if not m:
            return False
        at, kind = m.end(), m.lastindex
        if kind <= 2:
            if kind == 1 and not _bracket_ok(m[0]):
                return False
            prev = "atom"
        elif kind == 3:
            if prev not in ("atom", "ring", "bond") or (prev == "bond" and bond_open):
                return False
            label = m[0].strip("%()") .lstrip("0") or "0"
            rings[label] = not rings.get(label, False)
            prev = "ring"
        elif kind == 4:
            if prev not in ("atom", "ring", "open", "close"):
                return False
            bond_open = prev == "open"
            prev = "bond"
        elif kind == 5:
            if prev not in ("atom", "ring", "close"):
                return False
            stack.append(at)
            prev = "open"
        elif kind == 6:
            if not stack or prev not in ("atom", "ring", "close"):
                return False
            stack.pop()
            prev = "close"
        else:
            if prev not in ("atom", "ring", "close"):
                return False
            prev = "dot"
    return prev in ("atom", "ring", "close") and not stack and not any(rings.values())
