"""Operator 12: phrase collocations by the stripes pattern.

A stripe belongs to a prefix and counts the words that follow it. One structure answers all that the
scores need: the entries of the stripe of a two-word prefix are the three-word phrases (its
extensions), its total is the prefix's own frequency, and its largest entry tells whether an
extension subsumes the prefix. Stripes are counted per block of documents, merged element by
element per bucket of prefixes, and only what reaches the least frequency goes on.

1. One scan cuts the texts into words. A block (some MB of text) keeps the sequence of its words as
   numbers and tells its distinct words with their counts, by hash bucket: the stripe of the empty
   prefix. The table is written once; both steps below read it.
2. A bucket merges the counts of its words and gives those an identifier that are frequent enough
   to be in a candidate at all. Blocks get identifiers and counts back.
3. A block counts its two-word prefixes' stripes, over identifiers; any other word, and the end of
   a piece, stand in them as one common entry, which only the total needs. A bucket merges stripes
   and keeps phrases and totals that reach the least frequency.
4. Scores, subsumption and ranks are DataFrame operations over these.

Skew: stripes are pre-aggregated in their block. A prefix that could occur more than
``STRIPE_OCCURRENCES`` times, which all blocks tell from the counts of its two words, is dealt as
several stripes by its next word; their totals are added up afterwards. The number of buckets
follows the bytes of text and has no ceiling.

Cases: a null or empty text has no words; a null language is ``und``; rows without identifier and
repeated rows count like any others; a very long text is a block by itself; no text or no
candidate gives no rows; only the named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import read, slices, words_of
from shelfspark.llm.byte_bpe import packed, unpacked
from shelfspark.session import cut_lineage

LEAST = 10
#: A longer candidate with this share of a phrase's frequency subsumes it (in hundredths).
SUBSUMED = 50
MOST_PHRASES = 2000
SCALE = 1_000_000
#: Bytes of text in a block, and for each bucket of words or stripes.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Occurrences of a prefix for each of the stripes that it is dealt as.
STRIPE_OCCURRENCES = 1 << 20
#: Rows of the word table that may be broadcast; a longer one is joined by shuffle.
BROADCAST_WORDS = 500_000

_OTHER = -1  # the end of a piece or a word that is too rare, as a next word


def tokens(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(numbers, words, languages): the words of all texts in order as numbers of distinct pairs of word and
    language, -1 at every end of a piece."""
    texts = pc.ascii_lower(pc.replace_substring(texts, "\t", " "))
    texts = pc.replace_substring_regex(texts, r"[.,;:!?\n\v\f\r]", " \n ")
    codes, offsets, words = words_of(texts)
    langs = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    kinds = len(langs.dictionary)
    lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets))
    drop, stop = pc.index(words, "").as_py(), pc.index(words, "\n").as_py()
    key = codes * max(kinds, 1) + lang
    key[codes == stop] = -1
    starts = offsets[1:-1]  # a text ends a piece
    keep = codes != drop
    place = np.cumsum(keep) - keep
    key, cuts = key[keep], np.minimum(place[starts[starts < len(place)]], keep.sum())
    key = np.insert(key, cuts, -1)
    seen = np.zeros(len(words) * max(kinds, 1) + 1, bool)
    seen[key] = True  # -1: the last, spare entry
    seen[-1] = False
    used = np.flatnonzero(seen)
    number = np.cumsum(seen) - 1
    numbers = np.where(key < 0, -1, number[key]).astype(np.int32)
    if len(numbers):  # one -1 is as good as several
        numbers = numbers[(numbers >= 0) | (np.concatenate([[0], numbers[:-1]]) >= 0)]
    return numbers, words.take(pa.array(used // max(kinds, 1))), langs.dictionary.take(pa.array(used % max(kinds, 1)))


def stripes(numbers: np.ndarray, least_ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, second, next, count) of a block's two-word prefixes: numbers of words with an identifier
    (``least_ids`` >= 0), the next word also ``_OTHER``. Sorted by prefix and next word."""
    known = np.append(least_ids >= 0, False)  # number -1 is the last entry
    first, second = numbers[:-1], numbers[1:]
    at = np.flatnonzero(known[first] & known[second])
    after = np.append(numbers, -1)[at + 2]
    after = np.where(known[after], after, _OTHER)
    n = len(least_ids) + 1
    if n < 1 << 21:
        key, count = np.unique((first[at].astype(np.int64) * n + second[at]) * n + after + 1, return_counts=True)
        return key // n // n, key // n % n, key % n - 1, count
    order = np.lexsort((after, second[at], first[at]))
    table = np.stack([first[at], second[at], after], axis=1)[order].astype(np.int64)
    new = np.flatnonzero(np.any(np.diff(table, axis=0, prepend=np.full((1, 3), -2)) != 0, axis=1)) if len(table) else order
    return *table[new].T, np.diff(np.append(new, len(table)))


def merged(first: np.ndarray, second: np.ndarray, after: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stripes merged element by element: (first, second, next, count), sorted."""
    order = np.lexsort((after, second, first))
    first, second, after, count = first[order], second[order], after[order], count[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (after[1:] != after[:-1])
    at = np.flatnonzero(new)
    return first[at], second[at], after[at], np.add.reduceat(count, at) if len(at) else count[:0]


def totals(first: np.ndarray, second: np.ndarray, after: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(first, second, total, largest extension) of each prefix in merged stripes; an extension of fewer than
    ``least`` occurrences is no candidate and counts as 0."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return first, second, count, count
    return first[at], second[at], np.add.reduceat(count, at), np.maximum.reduceat(np.where((after == _OTHER) | (count < least), 0, count), at)


_WORDS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("ids", pa.binary()), ("id", pa.int64()), ("lang", pa.string()),
                    ("word", pa.string()), ("f", pa.int64())])


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, block_bytes: int = BLOCK_BYTES,
                  bucket_bytes: int = BUCKET_BYTES, stripe_occurrences: int = STRIPE_OCCURRENCES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: id, lang, word, f; n: lang, n; phrases: first, second, third, a, extended) of all words and phrases of
    at least ``least`` occurrences. ``third`` is null for a phrase of two words, whose ``extended`` is the
    frequency of its most frequent extension by a third word (0: none of at least ``least``)."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + int(size // bucket_bytes)

    def scan(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=block_bytes):
                numbers, words, langs = tokens(part.column("text").cast(pa.large_string()), part.column("lang"))
                count = np.bincount(numbers[numbers >= 0], minlength=len(words))
                bucket = np.fromiter((zlib.crc32(w) % buckets for w in words.cast(pa.large_binary()).to_pylist()), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(order) + 1, np.int32)
                place[order] = np.arange(len(order))
                place[-1] = -1
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                words, langs, count = words.take(pa.array(order)), langs.take(pa.array(order)), pa.array(count[order])
                told = [{"bucket": b, "words": packed(word=words[cuts[b]:cuts[b + 1]], lang=langs[cuts[b]:cuts[b + 1]].dictionary_encode(),
                                                      n=count[cuts[b]:cuts[b + 1]])} for b in np.flatnonzero(np.diff(cuts)).tolist()]
                yield pa.record_batch({"block": [block], "numbers": [packed(n=pa.array(place[numbers]))],
                                       "told": pa.array([told], pa.list_(pa.struct([("bucket", pa.int64()), ("words", pa.binary())])))})
                block += 1

    def merge_words(key, table):
        """Identifiers and counts of the frequent words of a bucket, for its blocks and as rows."""
        parts = [unpacked(w) for w in table.column("words").to_pylist()]
        every = pa.concat_tables([p.set_column(1, "lang", p.column("lang").cast(pa.string())) for p in parts])
        lang, word = every.column("lang").combine_chunks().dictionary_encode(), every.column("word").combine_chunks().dictionary_encode()
        of, n = word.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy(), every.column("n").to_numpy()
        key_of, of = np.unique(of, return_inverse=True)
        count = np.zeros(len(key_of), np.int64)
        np.add.at(count, of, n)
        frequent = count >= least
        ids = np.where(frequent, (key[0].as_py() << 32) + np.cumsum(frequent) - 1, -1)
        ends = np.cumsum([p.num_rows for p in parts])
        answers = [packed(id=pa.array(ids[of[a:b]]), f=pa.array(count[of[a:b]])) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        kept = np.flatnonzero(frequent)
        words = lambda at: word.dictionary.take(pa.array(key_of[at] // len(lang.dictionary))).cast(pa.string())
        langs = lambda at: lang.dictionary.take(pa.array(key_of[at] % len(lang.dictionary)))
        by_lang = np.zeros(len(lang.dictionary), np.int64)
        np.add.at(by_lang, key_of % len(lang.dictionary), count)
        none = lambda n, t: pa.nulls(n, t)
        a, k, g = len(answers), len(kept), len(by_lang)
        columns = [(table.column("block").combine_chunks(), none(k + g, pa.int64())), (table.column("bucket").combine_chunks(), none(k + g, pa.int64())),
                   (pa.array(answers, pa.binary()), none(k + g, pa.binary())), (none(a, pa.int64()), pa.array(ids[kept]), none(g, pa.int64())),
                   (none(a, pa.string()), langs(kept), lang.dictionary), (none(a, pa.string()), words(kept), none(g, pa.string())),
                   (none(a, pa.int64()), pa.array(count[kept]), pa.array(by_lang))]
        return pa.table([pa.concat_arrays(c) for c in columns], schema=_WORDS)

    def send_stripes(left, right):
        out = []
        if right.num_rows:
            answers = pa.concat_tables([unpacked(x) for x in right.sort_by("bucket").column("ids").to_pylist()])
            ids, f = answers.column("id").to_numpy(), answers.column("f").to_numpy()
            first, second, after, count = stripes(unpacked(left.column("numbers")[0].as_py())["n"].to_numpy(), ids)
            parts = 1 + np.minimum(f[first], f[second]) // stripe_occurrences
            first, second, after = ids[first], ids[second], np.where(after >= 0, ids[after], _OTHER)
            mix = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            mix += after.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) % parts.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            mix ^= mix >> np.uint64(32)
            bucket = (mix * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                i = order[cuts[b]:cuts[b + 1]]
                out.append((b, packed(first=pa.array(first[i]), second=pa.array(second[i]), next=pa.array(after[i]), n=pa.array(count[i]),
                                      whole=pa.array(parts[i] == 1))))
        cols = list(zip(*out)) or [[], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "stripes": pa.array(cols[1], pa.binary())})

    def merge_stripes(key, table):
        every = pa.concat_tables([unpacked(x) for x in table.column("stripes").to_pylist()])
        first, second, after, count = merged(*(every.column(c).to_numpy() for c in ("first", "second", "next", "n")))
        one, two, total, longest = totals(first, second, after, count, least)
        # a stripe that is dealt in parts is told whatever its total here
        partial = every.filter(pc.invert(every.column("whole"))).select(["first", "second"]).group_by(["first", "second"]).aggregate([])
        told = total >= least
        if partial.num_rows:
            told |= pc.is_in(pc.binary_join_element_wise(pa.array(one).cast(pa.string()), pa.array(two).cast(pa.string()), " "),
                             pc.binary_join_element_wise(partial["first"].cast(pa.string()), partial["second"].cast(pa.string()), " ").combine_chunks()).to_numpy(zero_copy_only=False)
        long = (count >= least) & (after != _OTHER)
        columns = [(one[told], first[long]), (two[told], second[long]), (pa.nulls(int(told.sum()), pa.int64()), pa.array(after[long])),
                   (total[told], count[long]), (longest[told], np.zeros(long.sum(), np.int64))]
        return pa.table({c: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in pair])
                         for c, pair in zip(("first", "second", "third", "a", "extended"), columns)})

    blocks = cut_lineage(rows.mapInArrow(scan, "block long, numbers binary, told array<struct<bucket: long, words: binary>>"), "word-blocks")
    told = blocks.select("block", F.explode("told").alias("t")).select("block", "t.bucket", "t.words")
    words = cut_lineage(told.groupBy("bucket").applyInArrow(
        merge_words, "block long, bucket long, ids binary, id long, lang string, word string, f long"), "words")
    sent = (blocks.select("block", "numbers").groupBy("block")
            .cogroup(words.where("block is not null").select("block", "bucket", "ids").groupBy("block"))
            .applyInArrow(send_stripes, "bucket long, stripes binary"))
    found = cut_lineage(sent.groupBy("bucket").applyInArrow(merge_stripes, "first long, second long, third long, a long, extended long"), "stripes")
    pairs = (found.where("third is null").groupBy("first", "second").agg(F.sum("a").alias("a"), F.max("extended").alias("extended"))
             .where(F.col("a") >= least).select("first", "second", F.lit(None).cast("long").alias("third"), "a", "extended"))
    n = words.where("block is null and id is null").groupBy("lang").agg(F.sum("f").alias("n"))
    return words.where("id is not null").select("id", "lang", "word", "f"), n, pairs.unionByName(found.where("third is not null"))


def score(l, r, a="a"):  # noqa: E741
    """floor(SCALE * a * a / (l * r)), exact to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"(cast({SCALE} as decimal(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(l)} * {wide(r)})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, subsumed: int = SUBSUMED,
                 most: int = MOST_PHRASES, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of each language."""
    words, n, phrases = count_phrases(docs, text_col, lang_col, least, **sizes)
    small = words.count() <= BROADCAST_WORDS
    word = lambda name: (F.broadcast if small else lambda d: d)(
        words.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"), F.col("f").alias(f"{name}_f"),
                     *([F.col("lang")] if name == "first" else [])))
    longer = phrases.where("third is not null").drop("extended")
    pairs = cut_lineage(phrases.where("third is null").drop("third").join(word("first"), "first").join(word("second"), "second"), "pairs")
    left = longer.groupBy(F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("a").alias("preceded"))
    two = (pairs.join(left, ["first", "second"], "left")
           .where(F.lit(100) * F.greatest("extended", F.coalesce("preceded", F.lit(0))) < subsumed * F.col("a"))
           .select("lang", F.concat_ws(" ", "first_word", "second_word").alias("phrase"), "a", F.col("first_f").alias("l"), F.col("second_f").alias("r"))
           .withColumn("score", score("l", "r")))
    head = pairs.select("lang", "first", "second", "first_word", "second_word", "first_f", F.col("a").alias("head_a"))
    tail = pairs.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("second_word").alias("third_word"),
                        F.col("second_f").alias("third_f"), F.col("a").alias("tail_a"))
    three = (longer.join(head, ["first", "second"]).join(tail, ["second", "third"])
             .withColumn("one", score("first_f", "tail_a")).withColumn("two", score("head_a", "third_f"))
             .select("lang", F.concat_ws(" ", "first_word", "second_word", "third_word").alias("phrase"), "a",
                     F.when(F.col("one") <= F.col("two"), F.col("first_f")).otherwise(F.col("head_a")).alias("l"),
                     F.when(F.col("one") <= F.col("two"), F.col("tail_a")).otherwise(F.col("third_f")).alias("r"),
                     F.least("one", "two").alias("score")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = two.unionByName(three)
    # each language in parts first, so that no task ranks a whole language
    best = (best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return (best.join(F.broadcast(n), "lang")  # a row for each language
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), ones as (
  select lang, word, count(*) as f from (select lang, unnest(w) as word from words) group by lang, word
), totals as (
  select lang, sum(f)::bigint as n from ones group by lang
), twos as (
  select lang, u.x as x, u.y as y, count(*) as f
  from (select lang, unnest(list_transform(range(1, len(w)), lambda i: {'x': w[i], 'y': w[i + 1]})) as u from words where len(w) > 1)
  group by lang, x, y having count(*) >= 10
), threes as (
  select lang, u.x as x, u.y as y, u.z as z, count(*) as f
  from (select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {'x': w[i], 'y': w[i + 1], 'z': w[i + 2]})) as u
        from words where len(w) > 2)
  group by lang, x, y, z having count(*) >= 10
), longer as (
  select lang, x, y, max(f) as f from (
    select lang, x, y, f from threes union all select lang, y as x, z as y, f from threes) group by lang, x, y
), cuts as (
  select t.lang, t.x || ' ' || t.y as phrase, t.f as a, 1 as k, a.f as l, b.f as r
  from twos t join ones a on a.lang = t.lang and a.word = t.x join ones b on b.lang = t.lang and b.word = t.y
  left join longer g on g.lang = t.lang and g.x = t.x and g.y = t.y
  where 100 * coalesce(g.f, 0) < 50 * t.f
  union all
  select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, a.f, b.f
  from threes t join ones a on a.lang = t.lang and a.word = t.x join twos b on b.lang = t.lang and b.x = t.y and b.y = t.z
  union all
  select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, a.f, b.f
  from threes t join twos a on a.lang = t.lang and a.x = t.x and a.y = t.y join ones b on b.lang = t.lang and b.word = t.z
), scored as (
  select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts
), chosen as (
  select *, row_number() over (partition by lang, phrase order by score, k) as nth from scored
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase collate "C") as rank from chosen where nth = 1
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""
