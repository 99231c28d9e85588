"""Fixed values that results depend on: word lists, replacement tables and weights."""

from __future__ import annotations

import unicodedata

# Words of legal forms.
LEGAL = (
    "inc incorporated corp corporation co company llc llp ltd limited pvt private plc "
    "sarl sasu sas sa eurl eirl snc sci gmbh bv nv ag spa srl"
).split()

# Words without meaning in names and in addresses.
NAME_NOISE = "mr mrs ms dr smt shri the www com net org co in".split()
ADDRESS_NOISE = "null none na nil".split()

# Abbreviations in addresses.
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane",
    "ct": "court", "pl": "place", "sq": "square", "hwy": "highway", "pkwy": "parkway", "ste": "suite",
    "apt": "apartment", "bldg": "building", "fl": "floor", "flr": "floor", "rm": "room", "dept": "department",
    "opp": "opposite", "nr": "near", "no": "number", "hno": "number", "sec": "sector", "ph": "phase",
    "colo": "colony", "mkt": "market", "ext": "extension", "n": "north", "s": "south", "e": "east", "w": "west",
    "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "bd": "boulevard",
}

# Replacements for phonetic keys, in the order in which they apply.
SOUNDS = (
    ("ph", "f"), ("gh", "g"), ("ck", "k"), ("kh", "k"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("sh", "s"),
    ("ch", "c"), ("qu", "k"), ("q", "k"), ("x", "ks"), ("z", "s"), ("w", "v"), ("y", "i"),
)
# The second table of them, which puts soft letters first and a hard c after qu and q.
SOUNDS_SOFT = (
    ("ge", "je"), ("gi", "ji"), ("gy", "ji"), ("ce", "se"), ("ci", "si"), ("cy", "si"),
    ("ph", "f"), ("gh", "g"), ("ck", "k"), ("kh", "k"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("sh", "s"),
    ("ch", "c"), ("qu", "k"), ("q", "k"), ("c", "k"), ("x", "ks"), ("z", "s"), ("w", "v"), ("y", "i"),
)

# Legal words as phonetic keys.
LEGAL_KEYS = (
    "erl gmb ink inkrprtd kmpn krp krprtn lmtd ltd plk prvt pvt snk srl elp elelp pvtltd prvtlmtd"
).split()

# Weights of key types.
KEY_WEIGHTS = {
    "name_full": 3.0, "name_sorted": 2.6, "name_phon": 2.0, "postal_token": 2.2, "digit_token": 1.3,
    "name_token": 1.0, "phon_token": 0.8, "name_prefix": 0.7, "addr_token": 0.6,
}


def _latin() -> tuple[str, str]:
    """Accented Latin letters and their bare ones, by decomposition."""
    pairs = []
    for code in range(0xC0, 0x180):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare.isascii() and bare.isalpha():
            pairs.append((chr(code), bare))
    more = (("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("ı", "i"))
    return "".join(a for a, _ in (*pairs, *more)), "".join(b for _, b in (*pairs, *more))


LATIN_FROM, LATIN_TO = _latin()
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"))
