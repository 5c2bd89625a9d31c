"""Operator 4: personal data by fixed patterns and a linear-chain conditional random field.

The patterns' matches (e-mail, IP address, card, phone) always stand. The field labels every
word of every text and adds what the patterns leave: secrets, numbers written otherwise. A word
of more than ``LONG_WORD`` characters (text without spaces, such as minified JSON or a URL) is cut
at punctuation, and each unit is labelled as a word. Spans of the field that touch a pattern's
span are dropped, and so are those that cannot be what they are marked as (``credible``).

Cases: a null text counts as empty; null identifiers and repeated rows are kept; a text of any
length is read whole; an empty table gives no rows; only the named columns are read
(``redact`` passes all others on unchanged).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import kept, read, slices, texts_of, words_of
from shelfspark.llm.crf import CLOSING, LABELS, OPENING, ChainField, shape

#: Bytes of text labelled at a time; scores and paths take some fifty times as much.
SLICE = 1 << 20
#: Words of more characters are cut into units at punctuation.
LONG_WORD = 64
_UNIT = re.compile(r"[^,;:&?#|/\\\"'`<>(){}\[\]，。；：？！、（）「」]+")
#: Shapes kept by a worker: their number, and their characters together.
KEPT_SHAPES, KEPT_CHARACTERS = 1 << 16, 1 << 22
#: Kinds in the order in which spans with the same start are listed.
KINDS = ["email", "ip", "card", "phone", "secret"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# whole runs of digits: a match never begins or ends inside one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
#: Words whose shape is told in C++.
_USUAL = [(r"^[a-zß-öø-ÿ]+[.,]?$", "a"), (r"^[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+[.,]?$", "Aa")]
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches: the local part reaches as far left of an @ as it can."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def credible(kind: str, text: str) -> bool:
    """Whether a span that the field marks can be what it says: a number that is no card's by its check digit,
    or no address by its parts, is just a number."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdecimal() and len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in parts)
    if kind == "email":
        return "@" in text.strip("@")
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return True


def _units(words: pa.Array, codes, rows, begin, length):
    """(units, codes, rows, begin, length): occurrences of words, the long ones as their units."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    long = np.flatnonzero(sizes > LONG_WORD)
    pieces = {int(c): [(m.start(), m[0]) for m in _UNIT.finditer(words[int(c)].as_py())] for c in long}
    if not pieces:
        return words, codes, rows, begin, length
    count = np.ones(len(words), np.int64)
    count[long] = [len(pieces[int(c)]) for c in long]
    first = np.cumsum(count) - count
    unit, at, size = np.repeat(np.arange(len(words)), count), np.zeros(count.sum(), np.int64), np.repeat(sizes, count)
    texts: list[str] = []
    for c, found in pieces.items():
        here = slice(first[c], first[c] + len(found))
        unit[here] = len(words) + len(texts) + np.arange(len(found))
        at[here], size[here] = [a for a, _ in found], [len(w) for _, w in found]
        texts += [w for _, w in found]
    times = count[codes]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    flat = np.repeat(first[codes], times) + nth
    return (pa.concat_arrays([words, pa.array(texts, words.type)]), unit[flat], np.repeat(rows, times),
            np.repeat(begin, times) + at[flat], size[flat])


class Finder:
    """Spans of whole texts; one per worker."""

    def __init__(self, field: ChainField):
        self.field = field
        self.place: dict[str, int] = {}  # shape to row of scores
        self.held = 0  # characters of these shapes
        self.scores = np.zeros((3, 0, len(LABELS)))
        self.edge = field.scores([])[:, 0]

    def _shapes(self, words: pa.Array) -> np.ndarray:
        """Rows of scores of the distinct words. Lower-case words, most of all, are shaped in C++."""
        usual = [(pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False), name) for pattern, name in _USUAL]
        plain = np.logical_or.reduce([hit for hit, _ in usual])
        out = np.full(len(words), -1, np.int64)
        shapes = [shape(w) for w in words.filter(pa.array(~plain)).to_pylist()]
        wanted = {*shapes, *(name for _, name in usual)}
        # shapes are made of the texts; what is kept is bounded
        if len(self.place) > KEPT_SHAPES or self.held > KEPT_CHARACTERS:
            self.place, self.held, self.scores = {}, 0, np.zeros((3, 0, len(LABELS)))
        new = sorted(wanted - self.place.keys())
        if new:
            base = len(self.place)
            self.place.update((s, base + i) for i, s in enumerate(new))
            self.held += sum(map(len, new))
            self.scores = np.concatenate([self.scores, self.field.scores(new)[:, :-1]], axis=1)
        for hit, name in usual:
            out[hit] = self.place[name]
        out[~plain] = [self.place[s] for s in shapes]
        return out

    def __call__(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, kind, end), sorted; a pattern's spans have kinds below
        ``len(KINDS)``, the field's have ``len(KINDS)`` added."""
        spaced = texts
        for c in "\n\t\r\v\f":
            spaced = pc.replace_substring(spaced, c, " ")
        codes, offsets, words = words_of(spaced)
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        ends = np.cumsum(length + 1)
        begin = ends - length - 1
        begin -= np.concatenate([[0], ends])[offsets[:-1]][rows]  # place in its own text
        real = ~empty[codes]
        units, code, row, begin, length = _units(words, codes[real], rows[real], begin[real], length[real])
        place = self._shapes(units)[code]
        n = len(place)
        starts = np.ones(n, bool)
        starts[1:] = row[1:] != row[:-1]
        finish = np.append(starts[1:], True) if n else starts
        own, behind, before = self.scores
        e = own[place]
        if n:
            e[1:] += np.where(starts[1:, None], self.edge[1], behind[place[:-1]])
            e[0] += self.edge[1]
            e[:-1] += np.where(finish[:-1, None], self.edge[2], before[place[1:]])
            e[-1] += self.edge[2]
        label = self.field.decode(e, starts)
        digit = pc.match_substring_regex(words, r"[0-9@]").to_numpy(zero_copy_only=False)
        found: list[list] = [[] for _ in range(len(texts))]
        for i in np.unique(rows[digit[codes]]).tolist():
            found[i] = base_spans(texts[i].as_py())
        hit = np.flatnonzero(label)
        if len(hit):
            cut = np.concatenate([[True], (np.diff(hit) > 1) | (label[hit[1:]] != label[hit[:-1]]) | starts[hit[1:]]])
            first = hit[cut]
            last = hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
            for a, b in zip(first.tolist(), last.tolist()):
                i, start, end = int(row[a]), int(begin[a]), int(begin[b] + length[b])
                text = texts[i].as_py()
                while start < end and text[start] in OPENING:
                    start += 1
                while start < end and text[end - 1] in CLOSING:
                    end -= 1
                kind = LABELS[label[a]]
                if start < end and credible(kind, text[start:end]) and not any(s < end and start < t for s, _, t in found[i]):
                    found[i].append((start, len(KINDS) + KINDS.index(kind), end))
            for i in np.unique(row[first]).tolist():
                found[i].sort(key=lambda s: (s[0], s[1] % len(KINDS)))
        return found


def _finder(shared) -> Finder:
    return kept(("pii", shared.id), lambda: Finder(shared.value))


class _Shared:
    """A broadcast value with an identity that workers can tell apart."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k % len(KINDS)]}:{a}:{b}" for a, k, b in spans)


def find_spans(docs: DataFrame, field: ChainField | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans (all)."""
    shared = _Shared(docs.sparkSession, field or ChainField())  # some hundred weights

    def run(batches):
        find = _finder(shared)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                found = find(texts_of(part))
                base = [[s for s in f if s[1] < len(KINDS)] for f in found]
                count = lambda k: pa.array([sum(s[1] == k for s in b) for b in base], pa.int64())  # noqa: E731, B023
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "n_email": count(0), "n_ip": count(1), "n_card": count(2), "n_phone": count(3),
                    "base_sha256": pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base], pa.string()),
                    "spans": pa.array([_listed(f) for f in found], pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: ChainField | None = None, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; a null text stays null.
    Where there is a length column it is set to the new length of texts that changed."""
    shared = _Shared(docs.sparkSession, field or ChainField())
    names = docs.columns

    def hidden(text, spans):
        out, at = [], 0
        for a, k, b in spans:
            if b > at:
                out += [text[at:max(a, at)], f"[{KINDS[k % len(KINDS)]}]"]
                at = b
        return "".join(out) + text[at:]

    def run(batches):
        find = _finder(shared)
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                found = find(texts_of(part, text_col))
                changed = {i: hidden(part.column(text_col)[i].as_py(), f) for i, f in enumerate(found) if f}
                mask = np.zeros(part.num_rows, bool)
                mask[list(changed)] = True
                columns = []
                for name in names:
                    c = part.column(name)
                    if name == text_col and changed:
                        c = pc.replace_with_mask(c, pa.array(mask), pa.array(list(changed.values()), c.type))
                    elif name == length_col and changed:
                        c = pc.replace_with_mask(c, pa.array(mask), pa.array([len(t) for t in changed.values()], c.type))
                    columns.append(c)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(read(spark, sf_dir, "documents"))
