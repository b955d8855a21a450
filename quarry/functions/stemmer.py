"""English stemmer: suffix tables, a Python function over them, and the same rules as SQL.

A word's regions R1 and R2 start after the first consonant that follows a vowel, and after the next such
place. In a step the first suffix that matches decides: it is rewritten if it lies in the step's region,
and otherwise ends the step. ``Y`` stands for a y that sounds as a consonant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ship

VOWELS = "aeiouy"
#: Words with a stem of their own, and words that stay.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
#: Prefixes after which R1 starts.
R1_AFTER = ("gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ")
#: Suffix, what replaces it, and the region (1 or 2) it must lie in, in order of trial.
STEP_2 = (
    ("ization", "ize", 1), ("ational", "ate", 1), ("fulness", "ful", 1), ("ousness", "ous", 1), ("iveness", "ive", 1),
    ("tional", "tion", 1), ("lessli", "less", 1), ("biliti", "ble", 1), ("iviti", "ive", 1), ("ation", "ate", 1),
    ("alism", "al", 1), ("aliti", "al", 1), ("ogist", "og", 1), ("ousli", "ous", 1), ("entli", "ent", 1), ("fulli", "ful", 1),
    ("alli", "al", 1), ("enci", "ence", 1), ("anci", "ance", 1), ("abli", "able", 1), ("izer", "ize", 1), ("ator", "ate", 1),
)
STEP_3 = (
    ("ational", "ate", 1), ("tional", "tion", 1), ("icate", "ic", 1), ("iciti", "ic", 1), ("alize", "al", 1),
    ("ative", "", 2), ("ical", "ic", 1), ("ness", "", 1), ("ful", "", 1),
)
STEP_4 = ("ement", "able", "ible", "ment", "ence", "ance", "sion", "tion", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
#: Words whose stems a worker keeps, and words of whole documents that it works on at once: its memory doesn't depend on how many rows Arrow puts in a batch.
KEPT, PIECE = 60_000, 250_000
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
SUCCEED = ("proceed", "succeed", "exceed", "proceedly", "succeedly", "exceedly")
OUTING = {6: ("inn", "out"), 7: ("cann", "herr", "even", "earr")}

_REGION = re.compile(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]")
_SHORT = re.compile(f"(?:[{VOWELS}][^{VOWELS}]|past|.*[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])", re.S)


def _after(word: str, start: int) -> int:
    found = _REGION.match(word, start)
    return found.end() if found else len(word)


def _short(word: str) -> bool:
    """Ends in a short syllable."""
    return bool(_SHORT.fullmatch(word))


def _first_vowel(word: str) -> int:
    return next((i for i, c in enumerate(word) if c in VOWELS), len(word))


class _Word:
    """A word with its regions, which shrink with it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.r1 = next((len(p) for p in R1_AFTER if text.startswith(p)), None) or _after(text, 0)
        self.r2 = _after(text, self.r1)

    def cut(self, n: int, put: str = "") -> None:
        self.text = self.text[: len(self.text) - n] + put
        self.r1, self.r2 = min(self.r1, len(self.text)), min(self.r2, len(self.text))

    def lies(self, n: int, region: int) -> bool:
        return (self.r1, self.r2)[region - 1] <= len(self.text) - n

    def rewrite(self, rules) -> bool:
        """Apply the first suffix that matches; whether there was one."""
        for suffix, put, region in rules:
            if self.text.endswith(suffix):
                if self.lies(len(suffix), region):
                    self.cut(len(suffix), put)
                return True
        return False


def _plural(w: _Word) -> None:
    if w.text.endswith("sses"):
        w.cut(2)
    elif w.text.endswith(("ied", "ies")):
        w.cut(1 if len(w.text) <= 4 else 2)
    elif w.text.endswith("s") and _first_vowel(w.text) < len(w.text) - 2 and w.text[-2] not in "su":
        w.cut(1)


def _past(w: _Word) -> None:
    text = w.text
    if text.endswith(SUCCEED):
        return
    if text.endswith("eed") or text.endswith("eedly"):
        size = 3 if text.endswith("eed") else 5
        if w.lies(size, 1):
            w.cut(size - 2)
        return
    suffix = next((s for s in ("ed", "edly", "ing", "ingly") if text.endswith(s) and _first_vowel(text) < len(text) - len(s)), None)
    if suffix is None:
        return
    if suffix == "ing":
        if len(text) == 5 and text[1] in "yY" and text[0] not in VOWELS:
            w.cut(4, "ie")
            return
        if text.startswith(OUTING.get(len(text), ())):
            return
    w.cut(len(suffix))
    text = w.text
    if text.endswith(("at", "bl", "iz")):
        w.text += "e"
        w.r2 = _after(w.text, w.r1)
    elif (len(text) > 3 or len(text) == 3 and text[0] not in "aeo") and text.endswith(DOUBLES):
        w.cut(1)
    elif text[-1:] != text[-2:-1] and _short(text) and w.r1 == len(text):
        w.text += "e"
        w.r2 = _after(w.text, w.r1)


def _second(w: _Word) -> None:
    if w.rewrite(STEP_2):
        return
    if w.text.endswith("bli") and w.lies(3, 1):
        w.cut(1, "e")
    elif w.text.endswith("ogi") and w.lies(3, 1):
        if w.text[-4:-3] == "l":
            w.cut(1)
    elif w.text.endswith("li") and w.lies(2, 1) and w.text[-3:-2] and w.text[-3] in BEFORE_LI:
        w.cut(2)


def _fourth(w: _Word) -> None:
    for suffix in STEP_4:
        if w.text.endswith(suffix):
            n = 3 if suffix in ("sion", "tion") else len(suffix)
            if w.lies(n, 2):
                w.cut(n)
            return


def _fifth(w: _Word) -> None:
    size = len(w.text)
    if w.text.endswith("e"):
        if w.r2 != size or w.r1 != size and not _short(w.text[:-1]):
            w.cut(1)
    elif w.text.endswith("ll") and w.r2 != size:
        w.cut(1)


@lru_cache(maxsize=KEPT)
def stem(word: str) -> str:
    """The stem of a lower-case word of letters and digits."""
    if len(word) < 3 or word in STAY:
        return word
    if word in OWN:
        return OWN[word]
    text = re.sub(f"([{VOWELS}])y", r"\1Y", re.sub("^y", "Y", word))
    if not any(c in VOWELS for c in text):
        return text.replace("Y", "\t")
    w = _Word(text)
    _plural(w)
    _past(w)
    if len(w.text) > 2 and w.text[-2] not in VOWELS and w.text[-1] in "yY":
        w.text = w.text[:-1] + "i"
    _second(w)
    w.rewrite(STEP_3)
    _fourth(w)
    _fifth(w)
    return w.text.replace("Y", "y")


def _pieces(lists: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, number of rows and words of each row, in pieces of PIECE words, and of one row where a row has more."""
    sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    ends, first = sizes.cumsum(), 0
    while first < len(sizes):
        held = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, held + PIECE, side="right")))
        yield first, last - first, sizes[first:last]
        first = last


def _coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct stems and, for each word, the place of its own; each distinct word is stemmed once."""
    flat = words.dictionary_encode()
    stems = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string()).dictionary_encode()
    return stems.dictionary, stems.indices.to_numpy()[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int32)


def _stem_lists(lists: pa.Array) -> Iterator[pa.Array]:
    """The stems of arrays of words, piece by piece."""
    for first, n, sizes in _pieces(lists):
        names, codes = _coded(lists.slice(first, n).flatten())
        yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), names.take(pa.array(codes)))


def _release() -> None:
    """A worker that waits for its next task holds no more than its words."""
    pa.default_memory_pool().release_unused()


def stemmed(words: Column) -> Column:
    """The stems of an array of words."""
    ship(SparkSession.active())

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        done = list(_stem_lists(lists))
        out = done[0] if len(done) == 1 else pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))
        _release()
        return out

    return run(words)


def stem_lists(docs: DataFrame, words: Column, name: str) -> DataFrame:
    """doc_id and the stems of its words: as ``stemmed``, but rows leave the worker piece by piece."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for stems in _stem_lists(batch.column("words")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(stems)), stems], names=["doc_id", name])
                first += len(stems)
            _release()

    return docs.select("doc_id", words.alias("words")).mapInArrow(run, f"doc_id {kind}, {name} array<string>")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n and terms of batches (doc_id, words), piece by piece."""
    for batch in batches:
        lists, ids = batch.column("words"), batch.column("doc_id")
        for first, many, sizes in _pieces(lists):
            names, codes = _coded(lists.slice(first, many).flatten())
            order = pa.compute.sort_indices(names).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            found, n = np.unique(np.repeat(np.arange(many), sizes) * max(len(order), 1) + place[codes], return_counts=True)
            rows = found // max(len(order), 1)
            offsets = pa.array(np.searchsorted(rows, np.arange(many + 1)), pa.int32())
            terms = names.take(pa.array(order[found % max(len(order), 1)])) if len(order) else names
            pairs = pa.StructArray.from_arrays([terms, pa.array(n.astype(np.int64))], ["term", "cnt"])
            yield pa.RecordBatch.from_arrays([ids.slice(first, many), pa.array(sizes), pa.ListArray.from_arrays(offsets, pairs)], names=["doc_id", "n", "terms"])
        _release()


def stem_counts(docs: DataFrame, words: Column) -> DataFrame:
    """doc_id, n (all words) and terms (each stem with its count, in order) of every document, whose words stay together: no shuffle."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", words.alias("words")).mapInArrow(counted, f"doc_id {kind}, n long, terms array<struct<term: string, cnt: long>>")


def stem_sql(words: str) -> str:
    """CTEs ``st_0`` to ``stems`` (word, stem) over a relation ``words`` (word), for engines with RE2 and CTEs.

    A chain of columns instead of a function: each CTE is one step, ``w`` the word, ``r1`` and ``r2`` its regions.
    """
    v, nv = f"[{VOWELS}]", f"[^{VOWELS}]"
    ends = lambda s: f"ends_with(w, '{s}')"
    cut = lambda n, put="": f"left(w, length(w) - {n}) || '{put}'"
    after = lambda text, start: f"({start} + coalesce(nullif(length(regexp_extract(substr({text}, {start} + 1), '^{nv}*{v}+{nv}')), 0), length({text}) - ({start})))"
    short = lambda text: f"regexp_full_match({text}, '{v}{nv}|past|.*{nv}{v}[^{VOWELS}wxY]')"
    first = f"(length(regexp_extract(w, '^{nv}*')))"
    region = {1: "r1", 2: "r2"}

    def table(rules) -> str:
        return " ".join(f"WHEN {ends(s)} THEN CASE WHEN {region[r]} <= length(w) - {len(s)} THEN {cut(len(s), put)} ELSE w END" for s, put, r in rules)

    def step(name: str, source: str, case: str) -> str:
        return f"{name} AS (SELECT word, w, least(r1, length(w)) AS r1, least(r2, length(w)) AS r2 FROM (SELECT word, r1, r2, {case} AS w FROM {source}))"

    any_of = lambda xs: "(" + " OR ".join(ends(x) for x in xs) + ")"
    own = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in OWN.items())
    prefix = " ".join(f"WHEN starts_with(w, '{p}') THEN {len(p)}" for p in R1_AFTER)
    outing = " OR ".join(f"length(w) = {n} AND starts_with(w, '{p}')" for n, ps in OUTING.items() for p in ps)
    last_two = "right(w, 1) <> coalesce(nullif(substr(w, length(w) - 1, 1), ''), '_')"
    parts = [
        f"st_0 AS (SELECT DISTINCT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({v})y', '\\1Y', 'g') AS w FROM {words})",
        f"st_1 AS (SELECT word, w, r1, {after('w', 'r1')} AS r2 FROM (SELECT word, w, CASE {prefix} ELSE {after('w', '0')} END AS r1 FROM st_0))",
        step("st_2", "st_1", f"CASE WHEN {ends('sses')} THEN {cut(2)} WHEN {any_of(('ied', 'ies'))} THEN CASE WHEN length(w) <= 4 THEN {cut(1)} ELSE {cut(2)} END WHEN {ends('s')} AND {first} < length(w) - 2 AND substr(w, length(w) - 1, 1) NOT IN ('s', 'u') THEN {cut(1)} ELSE w END"),
        "st_3 AS (SELECT word, w, r1, r2, CASE "
        f"WHEN {any_of(SUCCEED)} THEN 'stop' WHEN {ends('eed')} OR {ends('eedly')} THEN 'eed' "
        f"WHEN {ends('ed')} AND {first} < length(w) - 2 THEN 'ed' WHEN {ends('edly')} AND {first} < length(w) - 4 THEN 'edly' "
        f"WHEN {ends('ing')} AND {first} < length(w) - 3 THEN CASE WHEN length(w) = 5 AND substr(w, 2, 1) IN ('y', 'Y') AND NOT regexp_matches(w, '^{v}') THEN 'ying' WHEN {outing} THEN 'stop' ELSE 'ing' END "
        f"WHEN {ends('ingly')} AND {first} < length(w) - 5 THEN 'ingly' ELSE 'stop' END AS kind FROM st_2)",
        "st_4 AS (SELECT word, kind, w, least(r1, length(w)) AS r1, least(r2, length(w)) AS r2 FROM (SELECT word, kind, r1, r2, CASE kind "
        f"WHEN 'eed' THEN CASE WHEN {ends('eed')} THEN CASE WHEN r1 <= length(w) - 3 THEN {cut(1)} ELSE w END ELSE CASE WHEN r1 <= length(w) - 5 THEN {cut(3)} ELSE w END END "
        f"WHEN 'ying' THEN {cut(4, 'ie')} WHEN 'stop' THEN w ELSE left(w, length(w) - length(kind)) END AS w FROM st_3))",
        f"st_5 AS (SELECT word, w, r1, r2, CASE WHEN kind NOT IN ('ed', 'edly', 'ing', 'ingly') THEN '' WHEN {any_of(('at', 'bl', 'iz'))} THEN 'e' "
        f"WHEN (length(w) > 3 OR length(w) = 3 AND left(w, 1) NOT IN ('a', 'e', 'o')) AND {any_of(DOUBLES)} THEN 'cut' WHEN {last_two} AND {short('w')} AND r1 = length(w) THEN 'e' ELSE '' END AS fix FROM st_4)",
        f"st_6 AS (SELECT word, w, least(r1, length(w)) AS r1, CASE fix WHEN 'e' THEN {after('w', 'r1')} ELSE least(r2, length(w)) END AS r2 FROM (SELECT word, r1, r2, fix, CASE fix WHEN 'e' THEN w || 'e' WHEN 'cut' THEN {cut(1)} ELSE w END AS w FROM st_5))",
        step("st_7", "st_6", f"CASE WHEN length(w) > 2 AND NOT regexp_matches(substr(w, length(w) - 1, 1), '{v}') AND right(w, 1) IN ('y', 'Y') THEN {cut(1, 'i')} ELSE w END"),
        step("st_8", "st_7", f"CASE {table(STEP_2)} WHEN {ends('bli')} AND r1 <= length(w) - 3 THEN {cut(1, 'e')} WHEN {ends('ogi')} AND r1 <= length(w) - 3 THEN CASE WHEN {ends('logi')} THEN {cut(1)} ELSE w END WHEN {ends('li')} AND r1 <= length(w) - 2 AND regexp_matches(w, '[{BEFORE_LI}]li$') THEN {cut(2)} ELSE w END"),
        step("st_9", "st_8", f"CASE {table(STEP_3)} ELSE w END"),
        step("st_10", "st_9", "CASE " + " ".join(f"WHEN {ends(s)} THEN CASE WHEN r2 <= length(w) - {3 if s in ('sion', 'tion') else len(s)} THEN {cut(3 if s in ('sion', 'tion') else len(s))} ELSE w END" for s in STEP_4) + " ELSE w END"),
        step("st_11", "st_10", f"CASE WHEN {ends('e')} THEN CASE WHEN r2 <> length(w) OR r1 <> length(w) AND NOT {short('left(w, length(w) - 1)')} THEN {cut(1)} ELSE w END WHEN {ends('ll')} AND r2 <> length(w) THEN {cut(1)} ELSE w END"),
        f"stems AS (SELECT a.word, CASE WHEN length(a.word) < 3 OR a.word IN {STAY!r} THEN a.word ELSE CASE a.word {own} ELSE CASE WHEN NOT regexp_matches(b.w, '{v}') THEN replace(b.w, 'Y', chr(9)) ELSE replace(a.w, 'Y', 'y') END END END AS stem FROM st_11 a JOIN st_0 b ON a.word = b.word)",
    ]
    return ", ".join(parts)
