"""Weighted-dictionary classification (CLS-1..12).

Plan:
  files ──project(hay, name, joined keywords, locale)──> mapInArrow: each text is read once and
  passes the Aho-Corasick automata of all shards of the dictionary
      -> one row per file: (file_id, array of (dictionary row, tier))  [text is dropped here]
  -> explode -> join dictionary  (extension bonuses are 'ext' dictionary rows; unmatched files
     keep one empty row)
  -> ONE shuffle: repartition by file_id
  -> aggregate (file_id, category_id) -> window rank per file -> aggregate per file
     (all three reuse the file_id partitioning; no further exchange)

Contributions are summed as decimals so equal scores are real ties; the arg-max
breaks ties by category insertion order (``ord``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from shelfspark import constants as K
from shelfspark.functions.text import detect_language, name_suffix
from shelfspark.session import cut_lineage

# Dictionary rows of one automaton, and those that one scan of the texts takes, as shards that are
# broadcast; a larger dictionary is matched by several scans, which is exact.
BROADCAST_KEYWORD_CHUNK = 50_000
SCAN_KEYWORDS = 1_000_000
# Dictionary rows that go with the plan; more are written once, and joined by shuffle beyond the second.
PLAN_ROWS, BROADCAST_ROWS = 5_000, 500_000
# Distinct keywords that one scan of ``score_tables`` takes, and cells (keyword x category of a table) of a
# task's weight matrices; a larger dictionary is scored by several scans, which is exact.
SCORED_KEYWORDS, SCORED_CELLS = 250_000, 4_000_000
#: Bytes of text that ``score_tables`` scores at a time.
SCORE_BYTES = 1 << 20
CONTRIB = "decimal(22,9)"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over all cores when there are fewer input files than task slots
    (a few large row groups). On a cluster reading many files nothing is shuffled. Only the
    file listing is looked at; no job runs."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < slots:
        return df.repartition(slots * 2)
    return df


def prepare(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """CLS-1: haystack and document locale. ``files`` needs file_id, original_name,
    extracted_text, keywords (array<string>, may be NULL); the columns ``carry`` go along."""
    name_l = F.lower(F.coalesce(F.col("original_name"), F.lit("")))
    text = F.coalesce(F.col("extracted_text"), F.lit(""))
    kwj = F.lower(F.array_join(F.coalesce(F.col("keywords"), F.array().cast("array<string>")), " "))
    return files.select(
        *carry, "file_id",
        name_l.alias("_name"),
        kwj.alias("_kwj"),
        F.concat_ws(" ", name_l, F.lower(text), kwj).alias("_hay"),
        name_suffix(F.col("original_name")).alias("_ext"),
        detect_language(F.when(text != "", text).otherwise(name_l)).alias("locale_detected"),
    )


def _weighted(weight, tier, bonus) -> F.Column:
    return (weight.cast("decimal(18,8)") * (tier.cast("decimal(2,0)") * bonus.cast("decimal(2,1)"))).cast(CONTRIB)


def _parts(dict_df: DataFrame, n: int, most: int) -> list[DataFrame]:
    if n <= most:
        return [dict_df]
    parts = -(-n // most)
    keyed = dict_df.withColumn("_chunk", F.pmod(F.xxhash64("_kind", "kw_id", "category_id", "_kw"), F.lit(parts)))
    return [keyed.filter(F.col("_chunk") == i).drop("_chunk") for i in range(parts)]


def match_dictionary(categories: DataFrame, keywords: DataFrame) -> DataFrame:
    """Keyword rows of active categories plus one 'ext' row per (category, extension)."""
    cats = categories.filter("is_active")
    kw = keywords.join(F.broadcast(cats.select(F.col("id").alias("category_id"), "ord")), "category_id").select(
        F.lit("kw").alias("_kind"), "kw_id", "category_id", "ord", F.col("keyword").alias("_kw"),
        F.col("locale").alias("_kw_locale"), "weight")
    ext = cats.select(F.lit("ext").alias("_kind"), F.lit(-1).cast("bigint").alias("kw_id"),
                      F.col("id").alias("category_id"), "ord", F.explode("extensions").alias("_kw"),
                      F.lit(None).cast("string").alias("_kw_locale"), F.lit(None).cast("double").alias("weight"))
    return kw.unionByName(ext)


_AUTOMATA: dict[int, tuple] = {}


def _automata(shards) -> list[tuple]:
    """The automata of the shards and what they stand for, built once per worker. A shard is a table
    (idx, kind, keyword); an automaton gives places in its list of (keyword, [idx])."""
    import ahocorasick
    key = shards[0].bid
    if key not in _AUTOMATA:
        _AUTOMATA.clear()  # the latest dictionary only
        built, by_ext, always = [], {}, []
        for shard in shards:
            table = shard.value.value
            by_kw: dict[str, list[int]] = {}
            for idx, kind, kw in zip(*(table.column(c).to_pylist() for c in ("_idx", "_kind", "_kw"))):
                if kind == "ext":
                    by_ext.setdefault(kw, []).append(idx)
                elif kw:
                    by_kw.setdefault(kw, []).append(idx)
                else:
                    always.append(idx)
            entries = list(by_kw.items())
            automaton = ahocorasick.Automaton()
            for place, (kw, _) in enumerate(entries):
                automaton.add_word(kw, place)
            if entries:
                automaton.make_automaton()
                built.append((automaton, entries))
        _AUTOMATA[key] = (built, by_ext, always)
    return _AUTOMATA[key]


class _Shard:
    """A broadcast part of the dictionary, with an identity that workers can tell apart."""

    def __init__(self, spark, table):
        self.value = spark.sparkContext.broadcast(table)
        self.bid = self.value._jbroadcast.id()


def _annotator(shards, names: list[str]):
    """mapInArrow body: for each file, every dictionary row whose keyword occurs in
    the haystack (or whose extension equals the file suffix), with its tier."""
    from operator import itemgetter
    place_of = itemgetter(1)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from shelfspark.functions.batches import slices
        built, by_ext, always = _automata(shards)
        for batch in batches:
            for part in slices(batch, "_hay"):
                idx, tier, sizes = [], [], []
                for hay, name, kwj, ext in zip(*(part.column(c).to_pylist() for c in ("_hay", "_name", "_kwj", "_ext"))):
                    before = len(idx)
                    for automaton, entries in built:
                        for place in set(map(place_of, automaton.iter(hay))):
                            kw, rows = entries[place]
                            idx += rows
                            tier += [K.TIER_FILENAME if kw in name else K.TIER_KEYWORD if kw in kwj else K.TIER_TEXT] * len(rows)
                    idx += always
                    tier += [K.TIER_FILENAME] * len(always)
                    rows = by_ext.get(ext, ())
                    idx += rows
                    tier += [None] * len(rows)
                    sizes.append(len(idx) - before)
                hits = pa.StructArray.from_arrays([pa.array(idx, pa.int64()), pa.array(tier, pa.int32())], ["idx", "tier"])
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(ends, hits)], names=[*names, "hits"])

    return run


def _shared_dictionary(dict_df: DataFrame, n: int) -> tuple[DataFrame, list[_Shard]]:
    """(the dictionary with its numbers, its shards). Small ones go with the plan, others are written once."""
    spark = dict_df.sparkSession
    shape = "_idx bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dict_df.schema.fields)
    if n <= PLAN_ROWS:
        rows = dict_df.orderBy("_kind", "kw_id", "category_id", "_kw").collect()
        indexed = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], shape))
        table = indexed.select("_idx", "_kind", "_kw").toArrow()
    else:
        indexed = cut_lineage(dict_df.withColumn("_idx", F.monotonically_increasing_id()), "dictionary")
        table = indexed.select("_idx", "_kind", "_kw").toArrow()
        indexed = F.broadcast(indexed) if n <= BROADCAST_ROWS else indexed
    size = BROADCAST_KEYWORD_CHUNK
    return indexed, [_Shard(spark, table.slice(at, size)) for at in range(0, max(table.num_rows, 1), size)]


def annotate(prepped: DataFrame, categories: DataFrame, keywords: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(one row per file: the columns ``carry``, file_id, locale_detected and the ``hits``; the numbered dictionary
    that these refer to). The texts end here. For a dictionary of one scan."""
    dict_df = match_dictionary(categories, keywords)
    indexed, shards = _shared_dictionary(dict_df, dict_df.count())
    return _annotated(prepped, shards, carry), indexed


def _annotated(prepped: DataFrame, shards: list[_Shard], carry: tuple[str, ...] = ()) -> DataFrame:
    names = [*carry, "file_id", "locale_detected"]
    rows = prepped.select(*names, "_hay", "_name", "_kwj", "_ext")
    schema = StructType([*prepped.select(*names).schema.fields]).add("hits", ArrayType(StructType().add("idx", "long").add("tier", "integer")))
    return rows.mapInArrow(_annotator(shards, names), schema)


def _ac_matches(annotated: DataFrame, indexed: DataFrame, keep_unmatched: bool) -> DataFrame:
    explode = F.inline_outer if keep_unmatched else F.inline
    found = annotated.select("file_id", "locale_detected", explode("hits").alias("_idx", "tier"))
    return found.join(indexed, "_idx", "left")


def _null_matches(prepped: DataFrame, matched: DataFrame) -> DataFrame:
    """One empty row for every file that no chunk matched."""
    none = {f.name: f.dataType for f in matched.schema.fields}
    left = prepped.select("file_id", "locale_detected").join(matched.select("file_id").distinct(), "file_id", "left_anti")
    return left.select(*[F.col(c) if c in ("file_id", "locale_detected") else F.lit(None).cast(t).alias(c) for c, t in none.items()])


def dictionary_matches(prepped: DataFrame, categories: DataFrame, keywords: DataFrame,
                       keep_unmatched: bool = False, matcher: str = "ac") -> DataFrame:
    """CLS-2/3/4: one row per (file, dictionary row) whose keyword is a substring of
    the haystack (or whose extension equals the file suffix), with tier and locale
    bonus. With ``keep_unmatched`` files without any match keep one all-NULL row.
    ``matcher="join"`` states the same as a join on ``contains``, without Python."""
    dict_df = match_dictionary(categories, keywords)
    n = dict_df.count()  # the size check for what is broadcast
    if matcher == "ac":
        chunks = _parts(dict_df, n, SCAN_KEYWORDS)
        alone = len(chunks) == 1
        found = []
        for c in chunks:
            indexed, shards = _shared_dictionary(c, n if alone else c.count())
            found.append(_ac_matches(_annotated(prepped, shards), indexed, keep_unmatched and alone))
        tier = F.col("tier")
    else:
        chunks = _parts(dict_df, n, BROADCAST_KEYWORD_CHUNK)
        alone = len(chunks) == 1
        cond = (((F.col("_kind") == "kw") & F.col("_hay").contains(F.col("_kw")))
                | ((F.col("_kind") == "ext") & (F.col("_ext") == F.col("_kw"))))
        found = [prepped.join(F.broadcast(c), cond, "left" if keep_unmatched and alone else "inner") for c in chunks]
        tier = (F.when(F.col("_kind") == "ext", F.lit(None))
                .when(F.col("_name").contains(F.col("_kw")), F.lit(K.TIER_FILENAME))
                .when(F.col("_kwj").contains(F.col("_kw")), F.lit(K.TIER_KEYWORD))
                .otherwise(F.lit(K.TIER_TEXT)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    if keep_unmatched and not alone:
        out = out.unionByName(_null_matches(prepped, out))
    return _matched(out, tier)


def _matched(out: DataFrame, tier) -> DataFrame:
    bonus = F.when(F.col("_kw_locale") == F.col("locale_detected"), F.lit(K.LOCALE_BONUS)).otherwise(F.lit(1.0))
    return out.select("file_id", "locale_detected", "_kind", "category_id", "ord", "kw_id",
                      F.col("_kw").alias("keyword"), F.col("_kw_locale").alias("keyword_locale"), "weight",
                      tier.alias("tier"), bonus.alias("locale_bonus"))


def _contribution_rows(prepped: DataFrame, categories: DataFrame, keywords: DataFrame,
                       keep_unmatched: bool, matcher: str = "ac") -> DataFrame:
    return _contributions(dictionary_matches(prepped, categories, keywords, keep_unmatched, matcher))


def _contributions(m: DataFrame) -> DataFrame:
    label = (F.when(F.col("_kind") == "ext", F.concat(F.lit("extension "), F.col("keyword")))
             .when(F.col("tier") == K.TIER_FILENAME,
                   F.format_string("filename '%s' (w=%.1f)", F.col("keyword"), F.col("weight")))
             .when(F.col("tier") == K.TIER_KEYWORD,
                   F.format_string("keyword '%s' (w=%.1f)", F.col("keyword"), F.col("weight"))))
    contrib = (F.when(F.col("_kind") == "ext", F.lit(K.EXT_BONUS).cast(CONTRIB))
               .otherwise(_weighted(F.col("weight"), F.col("tier"), F.col("locale_bonus"))))
    return m.select("file_id", "category_id", "ord", contrib.alias("contrib"),
                    F.when(label.isNotNull(), F.struct(F.col("kw_id").alias("seq"), label.alias("text")))
                    .alias("label"),
                    "locale_detected")


def category_scores(prepped: DataFrame, categories: DataFrame, keywords: DataFrame,
                    partitions: int | None = None, with_markers: bool = False, matcher: str = "ac") -> DataFrame:
    """CLS-5: positive score per (file, category), hash-partitioned by file_id.

    Categories without a match score 0 and never win or get suggested, so they
    are not materialised. With ``with_markers`` a file without any match keeps one
    row with a NULL category (its detected locale rides on every row)."""
    return _scores(_contribution_rows(prepped, categories, keywords, with_markers, matcher), partitions)


def _scores(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    rows = rows.repartition(partitions, "file_id") if partitions else rows.repartition("file_id")
    return rows.groupBy("file_id", "category_id", "ord").agg(
        F.sum("contrib").alias("score_dec"),
        F.array_sort(F.filter(F.collect_list("label"), lambda x: x.isNotNull())).alias("labels"),
        F.max("locale_detected").alias("locale_detected"))


_WEIGHTS: dict[int, "_Weights"] = {}


class _Weights:
    """The keywords of a scan in a task: automata that give a keyword's place, and what a hit of each place adds to
    each group, in 1e-9 for tier 1 (whole numbers, so sums are exact in any order)."""

    def __init__(self, table, n_groups: int):
        import ahocorasick
        import numpy as np
        words = table.column("_kw").to_pylist()
        self.size, self.always, self.groups = len(words), [], n_groups
        plain, spaced = ahocorasick.Automaton(), ahocorasick.Automaton()
        for place, kw in enumerate(words):
            if not kw:
                self.always.append(place)
            else:  # a keyword without white space lies within a piece between white space
                (plain if kw.split() == [kw] else spaced).add_word(kw, place)
        self.plain, self.spaced = (a if len(a) and not a.make_automaton() else None for a in (plain, spaced))
        rows = table.column("rows").combine_chunks()
        flat = rows.flatten()
        self.place = np.repeat(np.arange(self.size), rows.value_lengths().to_numpy(zero_copy_only=False))
        self.group = flat.field("g").to_numpy(zero_copy_only=False)
        self.locale = np.array(flat.field("locale").to_pylist(), dtype=object)
        units = flat.field("units")
        self.valid = units.is_valid().to_numpy(zero_copy_only=False)
        self.units = units.fill_null(0).to_numpy(zero_copy_only=False)
        most = sum(abs(u) for u in self.units.tolist()) * K.TIER_FILENAME * 10 * max(K.LOCALE_BONUS, 1)
        self.dtype = np.int64 if most < 2**62 else object
        self.seen = self._flags(np.ones(len(self.valid), bool))
        self.scored = self.seen if self.valid.all() else self._flags(self.valid)
        self._by_locale: dict = {}

    def _flags(self, rows):
        import numpy as np
        out = np.zeros((self.size, self.groups), bool)
        out[self.place[rows], self.group[rows]] = True
        return out

    def of(self, locale):
        """(place, group) sums for texts of this locale."""
        import numpy as np
        if locale not in self._by_locale:
            same = (self.locale == locale) if locale is not None else np.zeros(len(self.locale), bool)
            out = np.zeros((self.size, self.groups), self.dtype)
            np.add.at(out, (self.place, self.group), self.units.astype(self.dtype) * np.where(same, round(K.LOCALE_BONUS * 10), 10))
            self._by_locale[locale] = out
        return self._by_locale[locale]

    def found(self, texts):
        """row * size + place of every keyword in every text, sorted, each once."""
        import numpy as np

        from shelfspark.functions.batches import expand, pieces
        second = lambda hit: hit[1]
        keys = []
        if self.plain is not None:
            codes, offsets, parts = pieces(texts)
            pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(offsets)) * max(len(parts), 1) + codes)
            row, code = np.divmod(pairs, max(len(parts), 1))
            places, sizes = [], []
            for part in parts.to_pylist():
                hits = set(map(second, self.plain.iter(part))) if part else ()
                places += hits
                sizes.append(len(hits))
            sizes = np.array(sizes, np.int64)
            starts = np.cumsum(sizes) - sizes
            keys.append(np.repeat(row, sizes[code]) * self.size + np.array(places, np.int64)[expand(starts[code], sizes[code])])
        if self.spaced is not None:
            keys += [np.array([i * self.size + p for p in set(map(second, self.spaced.iter(text)))], np.int64)
                     for i, text in enumerate(texts.to_pylist()) if text]
        keys += [np.arange(len(texts)) * self.size + p for p in self.always]
        return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)


def _scorer(shard: _Shard, n_groups: int, by_ext: dict[str, list[tuple[int, int]]]):
    """mapInArrow body: for each file a row without group, and one for each group with a hit: its sum of contributions in 1e-9."""
    def run(batches):
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        from shelfspark.functions.batches import slices
        if shard.bid not in _WEIGHTS:
            _WEIGHTS.clear()
            _WEIGHTS[shard.bid] = _Weights(shard.value.value, n_groups)
        w = _WEIGHTS[shard.bid]
        for batch in batches:
            for part in slices(batch, "_hay", SCORE_BYTES):
                keys = w.found(part.column("_hay"))
                tier = np.full(len(keys), K.TIER_TEXT, np.int64)
                for column, value in (("_kwj", K.TIER_KEYWORD), ("_name", K.TIER_FILENAME)):
                    tier[np.searchsorted(keys, w.found(part.column(column)))] = value
                ends = np.searchsorted(keys, np.arange(part.num_rows + 1) * w.size)
                place = keys % max(w.size, 1)
                rows, groups, units = [], [], []
                for i, (locale, ext) in enumerate(zip(part.column("locale_detected").to_pylist(), part.column("_ext").to_pylist())):
                    own = place[ends[i]:ends[i + 1]]
                    total = tier[ends[i]:ends[i + 1]].astype(w.dtype) @ w.of(locale)[own] if len(own) else np.zeros(n_groups, w.dtype)
                    seen, scored = w.seen[own].any(axis=0), w.scored[own].any(axis=0)
                    for g, n in by_ext.get(ext, ()):
                        total[g] += n * round(K.EXT_BONUS * 1e9)
                        seen[g] = scored[g] = True
                    hit = np.flatnonzero(seen)
                    rows += [i] * (1 + len(hit))
                    groups += [None, *hit.tolist()]
                    units += [None, *(u if s else None for u, s in zip(total[hit].tolist(), scored[hit].tolist()))]
                if w.dtype is object:
                    sums = pa.array([None if u is None else Decimal(u) for u in units], pa.decimal128(38, 0))
                else:
                    sums = pa.array(units, pa.int64()).cast(pa.decimal128(38, 0))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("file_id").take(at), part.column("locale_detected").take(at), pa.array(groups, pa.int32()), sums],
                                                 names=["file_id", "locale_detected", "g", "units"])
    return run


def score_tables(prepped: DataFrame, categories: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """CLS-5 by several keyword tables over the same categories, from one scan of the texts: (table: the place in
    ``tables``, file_id, category_id, ord, score_dec, locale_detected). For each file there is also a row without
    table and category.

    For dictionaries that hit a text thousands of times (learned words): a task adds up a file's contributions itself and
    hands on a row for each category, so neither hits nor their weights are moved. A distinct piece between white
    space passes the automaton once for some text, and sums are of whole 1e-9 (a weight has eight places and a
    bonus one), as exact as the decimals of ``category_scores``. There are no labels, hence no reasons."""
    spark = prepped.sparkSession
    dict_df = match_dictionary(categories, tables[0]).withColumn("table", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        dict_df = dict_df.unionByName(match_dictionary(categories, t).withColumn("table", F.lit(i)))
    key = ["table", "category_id", "ord"]
    named = [r.asDict() for r in dict_df.select(*key).distinct().orderBy(*key).collect()]  # at most categories x tables
    types = {f.name: f.dataType for f in dict_df.select(*key).schema.fields}
    groups = F.broadcast(spark.createDataFrame([(i, *(n[k] for k in key)) for i, n in enumerate(named)],
                                               StructType().add("g", "integer").add("table", "integer").add("category_id", types["category_id"]).add("ord", types["ord"])))
    units = (F.col("weight").cast("decimal(18,8)") * F.lit(10**8)).cast("bigint")
    numbered = dict_df.withColumn("units", F.when(F.col("_kind") == "kw", units)).join(groups, key)
    by_ext: dict[str, list[tuple[int, int]]] = {}
    for r in numbered.where("_kind = 'ext'").groupBy("_kw", "g").agg(F.count(F.lit(1)).alias("n")).collect():
        by_ext.setdefault(r["_kw"], []).append((r["g"], r["n"]))
    words = (numbered.where("_kind = 'kw'").groupBy("_kw", "g", F.col("_kw_locale").alias("locale")).agg(F.sum("units").alias("units"))
             .groupBy("_kw").agg(F.collect_list(F.struct("g", "locale", "units")).alias("rows")))
    words = cut_lineage(words, "scored-keywords")
    most = max(1, min(SCORED_KEYWORDS, SCORED_CELLS // max(len(named), 1)))
    parts = max(1, -(-words.count() // most))
    found = None
    for i in range(parts):
        own = words.where(F.pmod(F.xxhash64("_kw"), F.lit(parts)) == i) if parts > 1 else words
        body = _scorer(_Shard(spark, own.toArrow()), len(named), by_ext if i == 0 else {})
        rows = prepped.select("file_id", "locale_detected", "_hay", "_name", "_kwj", "_ext").mapInArrow(
            body, StructType([prepped.schema["file_id"], prepped.schema["locale_detected"]]).add("g", "integer").add("units", "decimal(38,0)"))
        found = rows if found is None else found.unionByName(rows)
    score = F.sum("units").cast("decimal(22,0)") * F.lit("0.000000001").cast("decimal(9,9)")
    return (found.repartition("file_id").groupBy("file_id", "g").agg(score.alias("score_dec"), F.max("locale_detected").alias("locale_detected"))
            .join(groups, "g", "left").select(*key[:1], "file_id", *key[1:], "score_dec", "locale_detected"))


def decide_table(scores: DataFrame, place: int, categories: DataFrame, keywords: DataFrame, locale: str = "zh") -> DataFrame:
    """CLS-6..12 by one table of ``score_tables``, without reasons."""
    own = scores.where((F.col("table") == place) | F.col("table").isNull()).drop("table")
    labels = F.array().cast("array<struct<seq:bigint,text:string>>")
    return _decided(own.withColumn("labels", labels), categories, keywords, locale).drop("reason")


def classify(files: DataFrame, categories: DataFrame, keywords: DataFrame, locale: str = "zh",
             partitions: int | None = None, matcher: str = "ac") -> DataFrame:
    """CLS-1..12 for every file.

    Output: file_id, category (display name or ``_inbox``), category_id, confidence
    (unrounded), score, locale_detected, suggestions array<string>, reason.
    """
    prepped = prepare(spread(files))
    scores = category_scores(prepped, categories, keywords, partitions, with_markers=True, matcher=matcher)
    return _decided(scores, categories, keywords, locale)


def classify_annotated(annotated: DataFrame, indexed: DataFrame, categories: DataFrame, keywords: DataFrame, locale: str = "zh") -> DataFrame:
    """CLS-3..12 from the rows of ``annotate``, without the texts."""
    rows = _contributions(_matched(_ac_matches(annotated, indexed, True), F.col("tier")))
    return _decided(_scores(rows), categories, keywords, locale)


def _decided(scores: DataFrame, categories: DataFrame, keywords: DataFrame, locale: str) -> DataFrame:
    cats = categories.select(F.col("id").alias("category_id"), "name_zh", "name_en")
    kw_count = keywords.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_kw"))
    w = Window.partitionBy("file_id").orderBy(F.col("score_dec").desc_nulls_last(), F.col("ord"))
    ranked = (scores.withColumn("rank", F.row_number().over(w))
              .filter(F.col("rank") <= K.MAX_SUGGESTIONS_FROM_TOP)
              .join(F.broadcast(cats), "category_id", "left")
              .join(F.broadcast(kw_count), "category_id", "left"))
    real = F.col("category_id").isNotNull()
    per_file = ranked.groupBy("file_id").agg(
        F.first(F.when(real & (F.col("rank") == 1), F.struct(
            F.col("category_id"), F.col("name_zh"), F.col("name_en"),
            F.col("score_dec").cast("double").alias("score"),
            F.coalesce(F.col("n_kw"), F.lit(0)).alias("n_kw"),
            F.col("labels"))), ignorenulls=True).alias("best"),
        F.array_sort(F.collect_list(F.when(real & (F.col("rank") > 1), F.struct("rank", "name_zh", "name_en"))))
        .alias("_others"),
        F.max("locale_detected").alias("locale_detected"))
    # CLS-12: 'auto' resolves to the detected language; zh (and auto->zh) shows name_zh
    if locale == "auto":
        use_zh = F.col("locale_detected") == "zh"
    else:
        use_zh = F.lit(locale == "zh")
    best = F.col("best")
    display = F.when(use_zh, best["name_zh"]).otherwise(best["name_en"])
    others = F.transform("_others", lambda o: F.when(use_zh, o["name_zh"]).otherwise(o["name_en"]))
    ceiling = F.greatest(best["n_kw"].cast("double") * F.lit(K.CEILING_PER_KEYWORD), F.lit(K.CEILING_MIN))
    # least() skips NULLs, so an unmatched file must be handled before it
    confidence = F.when(best.isNotNull(), F.least(best["score"] / ceiling, F.lit(1.0)))
    has_categories = bool(categories.filter("is_active").head(1))
    no_match_reason = K.REASON_NO_MATCH if has_categories else K.REASON_NO_CATEGORIES
    return per_file.select(
        "file_id",
        F.coalesce(display, F.lit(K.INBOX)).alias("category"),
        best["category_id"].alias("category_id"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
        F.coalesce(best["score"], F.lit(0.0)).alias("score"),
        "locale_detected",
        F.when(best.isNotNull() & (confidence < K.LOW_CONFIDENCE), others)
        .otherwise(F.array().cast("array<string>")).alias("suggestions"),
        F.coalesce(F.array_join(F.slice(F.transform(best["labels"], lambda l: l["text"]), 1, K.MAX_REASONS), "; "),
                   F.lit(no_match_reason)).alias("reason"))


def route(classified: DataFrame, threshold: float = K.LOW_CONFIDENCE) -> DataFrame:
    """CLS-11: confidence below the threshold goes to the review queue in _inbox."""
    low = F.col("confidence") < threshold
    return classified.select(
        "*",
        F.when(low, F.lit(K.INBOX)).otherwise(F.col("category")).alias("routed_to"),
        low.alias("needs_review"))
