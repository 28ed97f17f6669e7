"""The English (Porter2) stemmer, written from its published description; applied to arrays of terms as Arrow columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rules' endings and exceptions.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_PLURALS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
ROWS = 2_000  # arrays whose terms are Python objects at one time
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_REGION = re.compile(rf"{_VOWEL}{_OTHER}")


def _regions(w: str) -> tuple[int, int]:
    special = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    first = len(special) if special else _after(w, 0)
    return first, _after(w, first)


def _after(w: str, start: int) -> int:
    m = _REGION.search(w, start)
    return m.end() if m else len(w)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or word in INVARIANT:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    r1, r2 = _regions(w)
    w = re.sub(r"'(?:s'?)?$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in AFTER_PLURALS:
        return w
    # past and progressive
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[1] in ("eed", "eedly"):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif m and re.search(_VOWEL, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"
    w = re.sub(r"(?<=[^aeiouy])(?<!^.)[yY]$", "i", w) if len(w) > 2 else w
    # derivational endings
    for end in sorted([*STEP_2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(end):
            cut = len(w) - len(end)
            if cut >= r1:
                if end == "ogi":
                    w = w[:-1] if w[cut - 1 : cut] == "l" else w
                elif end == "li":
                    w = w[:cut] if w[cut - 1 : cut] in tuple("cdeghkmnrt") else w
                else:
                    w = w[:cut] + STEP_2[end]
            break
    for end in sorted([*STEP_3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            cut = len(w) - len(end)
            if end == "ative":
                w = w[:cut] if cut >= r2 else w
            elif cut >= r1:
                w = w[:cut] + STEP_3[end]
            break
    for end in sorted([*STEP_4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            cut = len(w) - len(end)
            if cut >= r2 and (end != "ion" or w[cut - 1 : cut] in ("s", "t")):
                w = w[:cut]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(tokens: Column) -> Column:
    """Every term of an array stemmed. A batch is taken ``ROWS`` arrays at a time, of which distinct terms are stemmed once."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from (_stems(batch.slice(i, ROWS)) for i in range(0, len(batch), ROWS))

    return run(tokens)


def _stems(arrays: pa.Array) -> pa.Array:
    found = arrays.flatten().dictionary_encode()
    stems = pa.array((stem(w) for w in found.dictionary.to_pylist()), pa.string())
    offsets = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stems.take(found.indices), mask=arrays.is_null() if arrays.null_count else None)
