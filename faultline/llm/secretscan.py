"""Secrets in texts: fixed patterns, and random strings found by how badly a tokenizer compresses them."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the base kinds, in the order in which equal starts are listed
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: lengths of hexadecimal digests in common use
DIGESTS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
#: camel and snake parts of a string: words, capitals or numbers
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
ABBREVIATION = re.compile(r"(?:(?<=[_/=+-])|^)(?:[A-Z]{2,5}|[A-Za-z])(?=[_/=+-]|$)")
#: what may be one rare or foreign word; it has to be this much worse than the ratio asks
ONE_WORD = re.compile(r"[A-Z]?[a-z]+")
ONE_WORD_SHARE = 0.9
#: letters of the shortest part that counts as a word, digits of the longest run inside an identifier
WORD_LETTERS, NUMBER_DIGITS = 3, 12
#: random strings have fewer characters per token than this
RATIO = 2.2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds; a match that is too short is dropped whole."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def looks_known(s: str, count_tokens: Callable[[str], int], ratio: float) -> bool:
    """Digests, UUIDs, numbers, and identifiers: strings whose camel or snake parts are words.

    A word has three letters or more and compresses as well as text does. Two to five capitals
    or one letter between separators are an abbreviation; runs of up to 12 digits may stand between words as long as letters prevail.
    """
    if len(s) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) or UUID.fullmatch(s):
        return True
    parts = PART.findall(ABBREVIATION.sub("", s))
    letters = [p for p in parts if not p.isdigit()]
    digits = [len(p) for p in parts if p.isdigit()]
    if not letters:
        return True
    if max(digits, default=0) > NUMBER_DIGITS or sum(digits) >= sum(map(len, letters)):
        return False
    return all(len(p) >= WORD_LETTERS and len(p) >= ratio * min(count_tokens(p), count_tokens(" " + p.lower())) for p in letters)


def random_spans(text: str, taken: list[tuple[int, int, int]], count_tokens, ratio: float) -> list[tuple[int, int, int]]:
    """Candidates with few characters per token that overlap no base span."""
    found = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        own = ratio * ONE_WORD_SHARE if ONE_WORD.fullmatch(s) else ratio
        if len(s) >= own * count_tokens(s) or looks_known(s, count_tokens, ratio):
            continue
        if all(m.end() <= a or b <= m.start() for a, _, b in taken):
            found.append((m.start(), 3, m.end()))
    return found


def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def find_secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """One row per row of docs with its spans, written kind:start:end and joined by commas.

    Positions are code points, ends exclusive, ordered by start and kind. A null or empty text has no
    spans. A null id stays null; repeated rows each get a row; extra columns are ignored; an empty table
    gives no rows. ``vocabulary`` is a tiktoken rank file that every worker can read. Each text is looked at
    on its own, whole, so there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, known = _encoding(vocabulary), {}

        def count_tokens(s: str) -> int:
            if s not in known:
                if len(known) > 100_000:
                    known.clear()
                known[s] = len(encoding.encode_ordinary(s))
            return known[s]

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for text in part.column(1):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    extra = random_spans(text, base, count_tokens, ratio)
                    written = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
                    everything = [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + extra)]
                    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                    rows.append([*n, hashlib.sha256(",".join(written).encode()).hexdigest(), ",".join(everything), len(extra)])
                names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*rows, strict=True))], ["doc_id", *names])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, SCHEMA)
