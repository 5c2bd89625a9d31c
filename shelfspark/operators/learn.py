"""Learning engine (LRN-1..9): corrections -> keyword weights.

A batch of corrections is an ordered fold per (category, keyword):

  corrections ─explode keywords─> events (category_id, keyword, seq, phase, pos, op, locale)
      ─groupBy(category_id, keyword)─> sorted event array
      ─left join─> current weights of that key pivoted per locale
      ─aggregate(events, state, step)─> new weights  (higher-order fold, no UDF)

Within one correction all penalties (phase 0, the "from" category) precede all
rewards (phase 1, the "to" category); repeated keywords compound. The fold keeps
the reference's floating-point operation order, so weights are bit-identical to
a sequential replay.

Only keys that receive events are shuffled; the rest of the dictionary is
carried over by an anti join. A fold row never holds more than
``MAX_EVENTS_PER_KEY`` events: hotter keys are folded in exact rounds (see
``apply_corrections``). The streaming learner (``streaming.jobs``) applies the
log in micro-batches, snapshotting the weights after each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.operators.dictionary import keyword_locale
from shelfspark.operators.ordered import ranked_within
from shelfspark.session import cut_lineage

LOCALES = ["zh", "en", "mixed"]
STATE_T = ("struct<zh:double,en:double,mixed:double,src_zh:string,src_en:string,src_mixed:string,"
           "other:boolean>")


def category_resolver(categories: DataFrame) -> DataFrame:
    """LRN-1: name -> category id. A name may be name_zh, name_en or the id (inactive
    categories included); the first category in insertion order wins."""
    names = categories.select(
        "id", "ord", F.explode(F.array("name_zh", "name_en", "id")).alias("name"))
    return names.groupBy("name").agg(F.min_by("id", "ord").alias("resolved_id"))


def resolve_corrections(corrections: DataFrame, categories: DataFrame) -> DataFrame:
    r = F.broadcast(category_resolver(categories))
    fr = r.select(F.col("name").alias("from_category"), F.col("resolved_id").alias("from_id"))
    to = r.select(F.col("name").alias("to_category"), F.col("resolved_id").alias("to_id"))
    return (corrections.join(fr, "from_category", "left").join(to, "to_category", "left")
            .withColumn("kw_locale", keyword_locale(F.coalesce("keywords", F.array().cast("array<string>")))))


def _strip_lower(c) -> F.Column:
    """Python ``kw.strip().lower()`` (strip removes Unicode whitespace)."""
    ws = K.WHITESPACE_RUN
    return F.lower(F.regexp_replace(c, f"^{ws}|{ws}$", ""))


def correction_events(resolved: DataFrame) -> DataFrame:
    """LRN-3/4/5 events: one 'down' per keyword for the from-category, one 'up' per
    keyword for the to-category, ordered by (seq, phase, pos)."""
    kws = resolved.select("seq", "from_id", "to_id", "kw_locale",
                          F.posexplode(F.coalesce("keywords", F.array().cast("array<string>"))).alias("pos", "kw"))
    kws = kws.select("seq", "from_id", "to_id", "kw_locale", "pos", _strip_lower(F.col("kw")).alias("keyword"))
    kws = kws.filter(F.col("keyword") != "")
    down = kws.filter(F.col("from_id").isNotNull()).select(
        F.col("from_id").alias("category_id"), "keyword", "seq", F.lit(0).alias("phase"), "pos",
        F.lit("down").alias("op"), F.col("kw_locale").alias("locale"))
    up = kws.filter(F.col("to_id").isNotNull()).select(
        F.col("to_id").alias("category_id"), "keyword", "seq", F.lit(1).alias("phase"), "pos",
        F.lit("up").alias("op"), F.col("kw_locale").alias("locale"))
    return down.unionByName(up)


def _pivot_state(keywords: DataFrame) -> DataFrame:
    """Current weights per (category_id, keyword) as one struct with a slot per locale
    and a flag for rows in any other locale."""
    agg = [F.max(F.when(F.col("locale") == l, F.col("weight"))).alias(l) for l in LOCALES]
    agg += [F.max(F.when(F.col("locale") == l, F.col("source"))).alias("src_" + l) for l in LOCALES]
    agg += [F.max(~F.col("locale").isin(*LOCALES)).alias("other"),
            F.min("kw_id").alias("kw_id")]
    return keywords.groupBy("category_id", "keyword").agg(*agg)


def _step(state, ev):
    """One event applied to the per-key state (mirrors the reference's SQL order)."""
    loc = ev["locale"]
    out = {}
    any_row = (state["zh"].isNotNull() | state["en"].isNotNull() | state["mixed"].isNotNull()
               | F.coalesce(state["other"], F.lit(False)))
    for l in LOCALES:
        cur = state[l]
        src = state["src_" + l]
        mine = loc == l
        down_w = (F.when(cur.isNotNull(), F.greatest(cur * F.lit(K.DOWN_FACTOR), F.lit(K.DOWN_FLOOR)))
                  .when(~any_row, F.lit(K.NEW_DOWN_WEIGHT)))
        down_s = F.when(cur.isNotNull(), F.lit("learned")).when(~any_row, F.lit("corrected_down"))
        up_w = F.when(cur.isNotNull(), F.least(cur * F.lit(K.UP_FACTOR) + F.lit(K.UP_ADD), F.lit(K.UP_CAP))) \
            .otherwise(F.lit(K.NEW_UP_WEIGHT))
        is_down = ev["op"] == "down"
        out[l] = F.when(mine & is_down, down_w).when(mine, up_w).otherwise(cur)
        out["src_" + l] = F.when(mine & is_down, F.coalesce(down_s, src)).when(mine, F.lit("learned")).otherwise(src)
    out["other"] = state["other"]
    return F.struct(*[out[k].alias(k) for k in
                      ["zh", "en", "mixed", "src_zh", "src_en", "src_mixed", "other"]])


# A fold row holds at most this many events of one (category, keyword); keys with
# more are folded in rounds of this size (exact: the state is carried over).
MAX_EVENTS_PER_KEY = 200_000
KEY = ["category_id", "keyword"]
BORN_T = "struct<seq:bigint,phase:int,pos:int,li:int>"
ORDER = ["seq", "phase", "pos"]


def apply_corrections(keywords: DataFrame, categories: DataFrame, corrections: DataFrame,
                      partitions: int | None = None, max_events_per_key: int = MAX_EVENTS_PER_KEY) -> DataFrame:
    """LRN-5: new keyword_weights after folding ``corrections`` (seq, filepath,
    from_category, to_category, keywords array<string>) in seq order.

    Keys with at most ``max_events_per_key`` events are folded in one pass. Hotter
    keys (one keyword may carry a third of all corrections) get exact per-key event
    ranks from a range-partitioned prefix count and are folded in rounds of at most
    ``max_events_per_key`` events per key, the weights written to the shared folder
    between rounds — no key's history is ever gathered into one row or one task."""
    # the corrections' input is read once; the gate and the folds read the written events
    ev = cut_lineage(correction_events(resolve_corrections(corrections, categories)), "learn-events")
    sizes = ev.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(sizes.filter(F.col("_n") > max_events_per_key).select(*KEY), "learn-hot-keys")
    tagged = keywords.withColumn("_born", F.lit(None).cast(BORN_T))
    out = _apply_events(tagged, ev.join(hot, KEY, "left_anti"))
    if hot.head(1):
        ranked = _ranked_events(ev.join(hot, KEY, "left_semi"))
        ranked = cut_lineage(ranked.withColumn("_chunk", ((F.col("_rank") - 1) / max_events_per_key).cast("bigint")),
                             "learn-hot-events")
        rounds = ranked.select(F.max("_chunk")).first()[0] + 1
        state = cut_lineage(tagged.join(hot, KEY, "left_semi"), "learn-hot-state")
        for r in range(rounds):
            chunk = ranked.filter(F.col("_chunk") == r).drop("_chunk", "_rank")
            state = cut_lineage(_apply_events(state, chunk), "learn-hot-state")
        out = out.join(hot, KEY, "left_anti").unionByName(state)
    return _numbered(cut_lineage(out, "learn-weights"))


def _numbered(keywords: DataFrame) -> DataFrame:
    """New rows get ids behind all others, in the order of the events that made them."""
    base = keywords.select(F.max("kw_id")).first()[0]
    new = keywords.filter(F.col("kw_id").isNull())
    named = ranked_within(new.select("*", "_born.*"), [], ["seq", "phase", "pos", "li", *KEY])
    columns = [c for c in keywords.columns if c not in ("kw_id", "_born")]
    return keywords.filter(F.col("kw_id").isNotNull()).select("kw_id", *columns).unionByName(
        named.select((F.lit(-1 if base is None else base) + F.col("_rank")).alias("kw_id"), *columns))


def _ranked_events(ev: DataFrame) -> DataFrame:
    return ranked_within(ev, KEY, ORDER)


def _apply_events(keywords: DataFrame, ev: DataFrame) -> DataFrame:
    """Fold ``ev`` (category_id, keyword, seq, phase, pos, op, locale) into ``keywords``. A row
    that this makes has no kw_id yet; ``_born`` tells its place in the order of events."""
    grouped = ev.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("seq", "phase", "pos", "op", "locale"))).alias("events"))
    state = _pivot_state(keywords)
    j = grouped.join(state, KEY, "left")
    init = F.struct(*[F.col(l).alias(l) for l in LOCALES], *[F.col("src_" + l).alias("src_" + l) for l in LOCALES],
                    F.coalesce(F.col("other"), F.lit(False)).alias("other")).cast(STATE_T)
    # a missing row is made by the first 'up' of its locale, or, where the key has no row at
    # all, by a 'down' that is its first event
    e0 = F.col("events")[0]
    rowless = F.col("zh").isNull() & F.col("en").isNull() & F.col("mixed").isNull() & ~F.coalesce("other", F.lit(False))

    def maker(locale):
        up = F.get(F.filter("events", lambda e: (e["op"] == "up") & (e["locale"] == locale)), F.lit(0))
        return F.when(rowless & (e0["op"] == "down") & (e0["locale"] == locale), e0).otherwise(up)

    folded = j.select(*KEY, *[maker(l).alias("made_" + l) for l in LOCALES], F.aggregate("events", init, _step).alias("s"))
    rows = folded.select(
        *KEY,
        F.explode(F.array(*[F.struct(F.lit(l).alias("locale"), F.col("s")[l].alias("weight"),
                                     F.col("s")["src_" + l].alias("source"), F.lit(i).alias("li"),
                                     F.col("made_" + l).alias("made"))
                            for i, l in enumerate(LOCALES)])).alias("r"))
    rows = rows.filter(F.col("r.weight").isNotNull())
    touched_keys = grouped.select(*KEY)
    # keys with events keep their rows in other locales unchanged
    others = (keywords.join(touched_keys, KEY, "left_semi")
              .filter(~F.col("locale").isin(*LOCALES)))
    existing_ids = keywords.select(*KEY, "locale", F.col("kw_id").alias("_old_id"), F.col("_born").alias("_old_born"), F.lit(True).alias("_had"))
    born = F.struct(F.col("r.made.seq").cast("bigint").alias("seq"), F.col("r.made.phase").cast("int").alias("phase"),
                    F.col("r.made.pos").cast("int").alias("pos"), F.col("r.li").alias("li"))
    new_rows = (rows.select(*KEY, F.col("r.locale").alias("locale"), F.col("r.weight").alias("weight"), F.col("r.source").alias("source"), born.alias("_new_born"))
                .join(existing_ids, [*KEY, "locale"], "left")
                .select(F.col("_old_id").alias("kw_id"), *KEY, "locale", "weight", "source",
                        F.when(F.col("_had"), F.col("_old_born")).otherwise(F.col("_new_born")).alias("_born")))
    untouched = keywords.join(touched_keys, KEY, "left_anti")
    return untouched.unionByName(others).unionByName(new_rows)


def sample_counts(categories: DataFrame, corrections: DataFrame) -> DataFrame:
    """LRN-6: sample_count += number of corrections whose target resolves."""
    res = resolve_corrections(corrections, categories)
    n = res.filter(F.col("to_id").isNotNull()).groupBy(F.col("to_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("seq").alias("_last"))
    j = categories.join(F.broadcast(n), "id", "left")  # one row per category at most
    return j.select(*[(F.col("sample_count") + F.coalesce("_n", F.lit(0))).alias("sample_count")
                      if c == "sample_count" else F.col(c) for c in categories.columns])


def log_corrections(log: DataFrame | None, corrections: DataFrame) -> DataFrame:
    """LRN-7: append every correction (also unresolved ones); keywords as JSON text."""
    new = corrections.select("seq", "filepath", "from_category", "to_category",
                             F.to_json(F.coalesce("keywords", F.array().cast("array<string>"))).alias("keywords"))
    return new if log is None else log.unionByName(new)


def moves_to_corrections(files: DataFrame, moves: DataFrame) -> DataFrame:
    """LRN-8: a move (seq, path, category) of a file whose stored category is known
    and different becomes a correction carrying the file's stored keywords."""
    j = moves.join(files.select("path", F.col("category").alias("previous"), "keywords"), "path", "inner")
    return (j.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("category")))
            .select("seq", F.col("path").alias("filepath"), F.col("previous").alias("from_category"),
                    F.col("category").alias("to_category"),
                    F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")))


def learning_stats(log: DataFrame, keywords: DataFrame) -> DataFrame:
    """LRN-9: number of corrections and of keywords with source 'learned'."""
    learned = keywords.select(F.count_if(F.col("source") == "learned")).scalar()
    return log.agg(F.count(F.lit(1)).alias("total_corrections")).select(
        "total_corrections", learned.alias("learned_keywords"))


def top_corrected(log: DataFrame, n: int = K.TOP_CORRECTED) -> DataFrame:
    """LRN-9: the n most frequent correction targets (ties by name)."""
    return (log.groupBy(F.col("to_category").alias("category")).agg(F.count(F.lit(1)).alias("corrections"))
            .orderBy(F.col("corrections").desc(), F.col("category")).limit(n))
