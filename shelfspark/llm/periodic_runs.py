"""Operator 13: periodic runs of words, by uniting suffix classes in descending order of their LCP.

The words of a document are ranked by prefix doubling, which gives its suffix array and the longest
common prefixes (LCP) of neighbouring suffixes. The neighbours are then united, longest prefix
first, as Kruskal's algorithm takes edges: a set holds the positions, in order, whose suffixes
share at least the present LCP. When two sets are united, positions that become neighbours in the
merged order at a distance within the LCP seed a run: the words from the first position on repeat
with that distance, LCP words past the second. The distance is the smallest period there, since a
smaller one would have put a position between the two at a greater LCP. A seed whose period holds
one word to the left is no start of a run.

A run of at least four periods and six words has an LCP of five or more between its start and one
period on, so only documents that repeat five words are ranked and uniting stops below five.

Documents are worked off by themselves, some MB of text at a time, with no shuffle. Cases: a null
or empty text, or one of white space alone, has no words and no runs; a document without
identifier is never rewritten periodically; repeated rows are answered one by one; a very long text
takes memory by its length (some dozen bytes a word and rank level); an empty table gives no rows; only
the named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import read, slices, texts_of, words_of

#: Bytes of text worked off at a time.
SLICE = 2 << 20
#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: No run of that size has a smaller LCP between its start and one period on.
LEAST_LCP = min(max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) for q in range(1, LEAST_WORDS))

_SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")),
                    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def rewritten(n: int, doc_id: int | None) -> np.ndarray | None:
    """The word that stands at each place of a document made periodic; None if it stays as it is."""
    if doc_id is None or not n:
        return None
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def repeating(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Which documents may hold the same LEAST_LCP words twice (by hash: never too few)."""
    n = len(codes) - LEAST_LCP + 1
    found = np.zeros(n_docs, bool)
    if n > 0:
        h = (doc[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(LEAST_LCP):
            h = (h ^ codes[k:k + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        at = np.flatnonzero(doc[:n] == doc[LEAST_LCP - 1:])
        h = h[at]
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        found[doc[at[order[1:][same]]]] = True
    return found


def neighbours(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, position, LCP) of suffixes of the same document that are neighbours in its suffix
    array, with an LCP of at least LEAST_LCP. ``ends``: one past the last word, for each word."""
    n = len(codes)
    order = np.lexsort((codes, doc))
    new = np.ones(n, bool)
    new[1:] = (codes[order][1:] != codes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    size = np.diff(np.append(first, n))
    levels, open_, step = [rank.astype(np.int32)], np.sort(order[np.repeat(size, size) > 1]), 1
    while len(open_):
        ahead = open_ + step
        within = ahead < ends[open_]
        key = rank[open_] * (n + 1)
        key[within] += rank[ahead[within]] + 1
        by = np.argsort(key, kind="stable")
        key, at = key[by], open_[by]
        fresh, group = np.ones(len(at), bool), np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        group[1:] = rank[at][1:] != rank[at][:-1]
        cut, starts = np.flatnonzero(fresh), np.flatnonzero(group)
        size = np.diff(np.append(cut, len(at)))
        rank[at] += np.repeat(cut, size) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        open_ = np.sort(at[np.repeat(size, size) > 1])
        step *= 2
        levels.append(rank.astype(np.int32))
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    x, y = array[:-1], array[1:]
    # only neighbours that share the largest power of two of words up to LEAST_LCP
    k = min(LEAST_LCP.bit_length() - 1, len(levels) - 1)
    close = levels[k][x] == levels[k][y]
    x, y = x[close], y[close]
    lcp = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = x + lcp, y + lcp
        inside = np.flatnonzero((a < ends[x]) & (b < ends[y]))
        same = levels[k][a[inside]] == levels[k][b[inside]]
        lcp[inside[same]] += 1 << k
    deep = lcp >= LEAST_LCP
    return x[deep], y[deep], lcp[deep]


def unite(x: np.ndarray, y: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, period, LCP) of the seeds, from neighbouring suffixes and their LCP."""
    order = np.argsort(-lcp, kind="stable")
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    seeds = []

    def root(i: int) -> int:
        top = parent.setdefault(i, i)
        while parent[top] != top:
            parent[top] = top = parent[parent[top]]
        return top

    for a, b, shared in zip(x[order].tolist(), y[order].tolist(), lcp[order].tolist()):
        a, b = root(a), root(b)
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        reach = shared // (LEAST_PERIODS - 1)  # a greater distance has too few periods
        for i, p in enumerate(small):
            at = bisect(large, p)
            if at and p - large[at - 1] <= reach and (i == 0 or small[i - 1] < large[at - 1]):
                seeds.append((large[at - 1], p - large[at - 1], shared))
            if at < len(large) and large[at] - p <= reach and (i + 1 == len(small) or small[i + 1] > large[at]):
                seeds.append((p, large[at] - p, shared))
        if len(small) > 8:
            large += small
            large.sort()
        else:
            for p in small:
                insort(large, p)
        members[a] = large
    return seeds


def runs_of(codes: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period), sorted, of the runs in each document that has any; document i has
    the words codes[offsets[i]:offsets[i + 1]]."""
    n_docs = len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    chosen = repeating(codes, doc, n_docs)
    keep = chosen[doc]
    if not keep.any():
        return {}
    codes, doc = codes[keep], doc[keep]
    sizes = np.where(chosen, np.diff(offsets), 0)
    until = np.cumsum(sizes)
    begins = until - sizes
    found: dict[int, list[tuple[int, int, int]]] = {}
    for p, period, shared in unite(*neighbours(codes, doc, until[doc])):
        d = int(doc[p])
        start, length = p - int(begins[d]), shared + period
        if length >= max(LEAST_WORDS, LEAST_PERIODS * period) and (start == 0 or codes[p - 1] != codes[p + period - 1]):
            found.setdefault(d, []).append((start, length, period))
    return {d: sorted(r, key=lambda r: (r[0], r[2])) for d, r in found.items()}


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _joined(words: pa.Array, codes: np.ndarray) -> bytes:
    return b" ".join(words.take(pa.array(codes)).cast(pa.large_binary()).to_pylist())


def describe(doc_ids: list, texts: pa.Array) -> pa.RecordBatch:
    """The result rows of some documents."""
    for c in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, c, " ")
    loose = pc.match_substring_regex(texts, "^ |  | $")
    if pc.any(loose).as_py():
        tidy = pc.ascii_trim(pc.replace_substring_regex(texts.filter(loose), " +", " "), " ")
        texts = pc.replace_with_mask(texts, loose, tidy)
    codes, offsets, words = words_of(texts)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if empty.any():  # split gives one empty word
        mask = np.ones(len(codes), bool)
        mask[offsets[:-1][empty]] = False
        codes, offsets = codes[mask], offsets - np.concatenate([[0], np.cumsum(empty)])
    changed = {}
    codes = codes.copy()
    for i, (doc_id, a, b) in enumerate(zip(doc_ids, offsets[:-1].tolist(), offsets[1:].tolist())):
        at = rewritten(b - a, doc_id)
        if at is not None:
            codes[a:b] = codes[a:b][at]
            changed[i] = slice(None)
    found = runs_of(codes, offsets)
    rows = []
    for i, doc_id in enumerate(doc_ids):
        runs = found.get(i, [])
        a, b = int(offsets[i]), int(offsets[i + 1])
        if runs:
            dropped = np.zeros(b - a + 1, np.int64)
            for start, length, period in runs:
                dropped[start + period] += 1
                dropped[start + length] -= 1
            collapsed = _joined(words, codes[a:b][np.cumsum(dropped[:-1]) == 0])
            # exact: fractions of numbers below 2^31 differ by more than 2^-62
            start, length, period = max(runs, key=lambda r: ((r[1] << 64) // r[2], -r[0], -r[2]))
            best = (start, length, period, 1000 * length // period)
        else:
            collapsed = _joined(words, codes[a:b]) if i in changed else texts[i].as_py().encode()
            best = (None,) * 4
        listed = "".join("%d,%d,%d\n" % r for r in runs)
        rows.append((doc_id, len(runs), *best, _sha(listed.encode()), _sha(collapsed)))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_runs, its run of the greatest exponent (start, length, period,
    exponent_milli), runs_sha256 of all runs, collapsed_sha256 of the words left when every run
    is cut to its first period."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                yield describe(part.column("doc_id").to_pylist(), texts_of(part))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(read(spark, sf_dir, "documents"))


#: Runs as stretches of places whose word equals the one a period on. Places are compared where
#: four words in a row are equal, so words that are merely frequent make no pairs.
ORACLE = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), hashed as (
  select doc_id, w, len(w) as n,
         xor(list_reduce(flatten(list_prepend([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''),
           lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda crc, x: case when x >= 0 then xor(crc, x) else xor(crc >> 1, 3988292384 * (crc & 1)) end), 4294967295) as h
  from words
), cut as (
  select *, h // 10 as g, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a from hashed
), docs as (
  select doc_id, n, case when a is null then w else
    list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) end as w
  from cut
), places as (
  select doc_id, n, unnest(range(n)) as i, unnest(w) as word from docs
), grams as (
  select *, word || ' ' || lead(word, 1) over d || ' ' || lead(word, 2) over d || ' ' || lead(word, 3) over d as gram
  from places window d as (partition by doc_id order by i)
), pairs as (
  select x.doc_id, x.i, y.i - x.i as q, x.n
  from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and y.i > x.i and 4 * (y.i - x.i) <= x.n
), islands as (
  select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs
), stretches as (
  select doc_id, q, min(i) as s, count(*) + 3 + q as length from islands group by doc_id, q, island
), runs as (
  select doc_id, s, length, min(q) as q from stretches where length >= greatest(6, 4 * q) group by doc_id, s, length
), per_doc as (
  select doc_id, count(*) as n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) as listed from runs group by doc_id
), best as (
  select * from runs r
  where not exists (select 1 from runs o where o.doc_id = r.doc_id and (
    o.length * r.q > r.length * o.q or (o.length * r.q = r.length * o.q and (o.s < r.s or (o.s = r.s and o.q < r.q)))))
), gone as (
  select distinct doc_id, unnest(range(s + q, s + length)) as i from runs
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as text from places p
  where not exists (select 1 from gone g where g.doc_id = p.doc_id and g.i = p.i) group by doc_id
)
select d.doc_id, coalesce(p.n_runs, 0) as n_runs, b.s as start, b.length, b.q as period, 1000 * b.length // b.q as exponent_milli,
       sha256(coalesce(p.listed, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from docs d left join per_doc p using (doc_id) left join best b using (doc_id) left join kept k using (doc_id)
"""
