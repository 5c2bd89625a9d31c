"""Catalogue operators: searches (FLT), projections (PRJ), analytics (AGG) and the
state merges that replace row-at-a-time CRUD (SNK-1, AGG-10..13).

State tables are DataFrames; every mutating call is ``(state, feed) -> new state``.
Top-k operators always carry a unique tie-break (path) before their limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfspark import constants as K
from shelfspark.functions.text import ascii_fold, json_array, path_name, sqlite_like
from shelfspark.session import cut_lineage

def file_defaults() -> dict:
    """Column defaults of the ``files`` table for inserted rows."""
    return {
        "category": F.lit(K.INBOX),
        "confidence": F.lit(0.0),
        "importance": F.lit(0.0),
        "starred": F.lit(False),
        "view_count": F.lit(0).cast("bigint"),
    }


# ----------------------------------------------------------------------------
# SNK-1 upsert
# ----------------------------------------------------------------------------

def upsert(state: DataFrame, changes: DataFrame, key: str = "path", seq: str = "seq",
           defaults: dict | None = None) -> DataFrame:
    """Update the given (non-NULL) columns of existing keys, insert unknown keys with
    defaults. Several changes of one key apply in ``seq`` order (latest value per
    column wins). Columns of ``changes`` not in ``state`` are ignored."""
    defaults = file_defaults() if defaults is None else defaults
    cols = [c for c in changes.columns if c not in (key, seq) and c in state.columns]
    latest = changes.groupBy(key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias("_n_" + c) for c in cols])
    j = state.withColumn("_old", F.lit(True)).join(latest, key, "full_outer")
    out = []
    for c in state.columns:
        if c == key:
            out.append(F.col(key))
        elif c in cols:
            dflt = defaults.get(c)
            new_c = F.col("_n_" + c)
            old_c = F.when(F.col("_old").isNotNull(), F.col(c))
            if dflt is not None:
                out.append(F.coalesce(new_c, old_c, F.when(F.col("_old").isNull(), dflt)).alias(c))
            else:
                out.append(F.coalesce(new_c, old_c).alias(c))
        else:
            dflt = defaults.get(c)
            out.append((F.when(F.col("_old").isNull(), dflt).otherwise(F.col(c)) if dflt is not None
                        else F.col(c)).alias(c))
    return j.select(*out)


def json_lines(df: DataFrame, path: str | None = None) -> DataFrame:
    """SNK-3: one JSON document per row (non-ASCII kept as is); written as text
    files when ``path`` is given."""
    out = df.select(F.to_json(F.struct(*df.columns)).alias("json"))
    if path:
        out.write.mode("overwrite").text(path)
    return out


# ----------------------------------------------------------------------------
# FLT-1 file search
# ----------------------------------------------------------------------------

def search_hit(query: str) -> Column:
    """original_name, any keyword element or extracted_text LIKE %query% (SQLite rules), to be taken
    where the text is read."""
    return F.coalesce(sqlite_like(F.col("original_name"), query)
                      | F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: sqlite_like(k, query))
                      | sqlite_like(F.coalesce("extracted_text", F.lit("")), query), F.lit(False))


def search_files(files: DataFrame, query: str | None = None, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """Files that ``search_hit`` finds, ordered importance desc, view_count desc, path; top ``limit``. Without a
    ``query``, files has the hits as a column ``hit``, so that no text is moved with the catalogue."""
    return (files.filter(F.col("hit") if query is None else search_hit(query))
            .select("path", "category", "file_type", "original_name", "view_count", "importance",
                    "confidence", "last_accessed")
            .orderBy(F.col("importance").desc(), F.col("view_count").desc(), F.col("path"))
            .limit(limit))


# ----------------------------------------------------------------------------
# FLT-2..5 descriptions
# ----------------------------------------------------------------------------

def _query_terms(query: str) -> list[str]:
    return [t for t in query.split() if t.strip()]


def search_descriptions(descriptions: DataFrame, query: str, limit: int = K.DESCRIPTION_LIMIT) -> DataFrame:
    """AND of LIKE over the whitespace-split terms; total_hits before the limit;
    newest first. A blank query has no hits."""
    terms = _query_terms(query)
    if not terms:
        return descriptions.limit(0).select("path", "description", "updated_at",
                                            F.lit(0).cast("bigint").alias("total_hits"))
    cond = None
    for t in terms:
        c = sqlite_like(F.col("description"), t)
        cond = c if cond is None else cond & c
    hits = descriptions.filter(cond)
    total = hits.select(F.count(F.lit(1))).scalar()
    return (hits.select("path", "description", "updated_at", total.alias("total_hits"))
            .orderBy(F.col("updated_at").desc(), F.col("path")).limit(limit))


#: Length of the grams of the search index, and how many of a query's rarest ones are intersected.
GRAM, RAREST = 3, 2
#: Rows of a query table (queries, their grams) that may be broadcast; a longer one is joined by shuffle.
BROADCAST_QUERIES = 100_000
#: Queries without a gram that one pass over the descriptions tests.
SCAN_QUERIES = 5_000
_NO_ESCAPE = "\u0001"


def grams_of(text) -> Column:
    """The distinct substrings of GRAM characters."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))))


def search_batch(descriptions: DataFrame, queries: DataFrame, limit: int = K.DESCRIPTION_LIMIT) -> DataFrame:
    """FLT-3: many queries (query_id, query) against all descriptions, AND of LIKE per
    term, top ``limit`` per query (newest first) and total hits per query.

    An inverted index over grams finds the candidates: a description that a query hits holds all grams of the
    literal stretches of its terms. Postings are made for the queries' grams only; of these the rarest few of
    each query are intersected, and candidates are checked by LIKE. Queries without such a stretch (short terms,
    wildcards) are tested against every description, some thousand in a pass. A blank or null query and a null
    description have no hits."""
    q = queries.select("query_id", F.filter(F.split(F.trim(F.col("query")), r"(?U)\s+"), lambda t: t != "").alias("terms"))
    q = cut_lineage(q.filter(F.size("terms") > 0).select(
        F.monotonically_increasing_id().alias("_q"), "query_id", F.transform("terms", ascii_fold).alias("terms")), "queries")
    small = q.count() <= BROADCAST_QUERIES
    chunks = F.flatten(F.transform("terms", lambda t: F.split(t, "[%_\u0001]")))
    needed = q.select("_q", F.explode(F.array_distinct(F.flatten(F.transform(chunks, lambda c: F.coalesce(grams_of(c), F.array().cast("array<string>")))))).alias("gram"))
    d = descriptions.select("path", "updated_at", ascii_fold(F.col("description")).alias("_d"))
    wanted = needed.select("gram").distinct()
    held = d.select("path", F.explode(grams_of(F.col("_d"))).alias("gram"))
    postings = cut_lineage(held.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_QUERIES else wanted, "gram", "left_semi").distinct(), "postings")
    frequency = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = Window.partitionBy("_q").orderBy("n", "gram")
    chosen = (needed.join(frequency, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
              .withColumn("nth", F.row_number().over(rare)).where(F.col("nth") <= RAREST)
              .withColumn("grams", F.count(F.lit(1)).over(Window.partitionBy("_q"))).select("_q", "gram", "grams"))
    candidates = (postings.join(F.broadcast(chosen) if small else chosen, "gram").groupBy("_q", "path")
                  .agg(F.count(F.lit(1)).alias("met"), F.first("grams").alias("grams")).where("met = grams").select("_q", "path"))
    ask = q.select("_q", "query_id", "terms")
    # a term without wildcards needs no pattern, which LIKE would compile for every row
    meets = lambda t: F.when(t.rlike("[%_\u0001]"), F.like(F.col("_d"), F.concat(F.lit("%"), t, F.lit("%")), F.lit(_NO_ESCAPE))).otherwise(F.contains(F.col("_d"), t))
    found = (candidates.join(d, "path").join(F.broadcast(ask) if small else ask, "_q").where(F.forall("terms", meets))
             .select("_q", "query_id", "path", "updated_at"))
    short = cut_lineage(q.join(needed.select("_q").distinct(), "_q", "left_anti"), "short-queries")
    hits = cut_lineage(found, "search-hits")
    passes = -(-short.count() // SCAN_QUERIES)
    shape = f"array<struct<_q: bigint, query_id: {q.schema['query_id'].dataType.simpleString()}, terms: array<string>>>"
    for i in range(passes):  # a stated set of queries against all rows, in blocks of some thousand
        block = short.where(F.pmod(F.xxhash64("_q"), F.lit(passes)) == i).agg(F.to_json(F.collect_list(F.struct("_q", "query_id", "terms")))).first()[0]
        met = F.filter(F.from_json(F.lit(block), shape), lambda x: F.forall(x["terms"], meets))
        hits = hits.unionByName(d.where("_d is not null").select("path", "updated_at", F.inline(met)).select("_q", "query_id", "path", "updated_at"))
    # per-query top-k (partial top-k before the shuffle) and hit counts by aggregate,
    # so a query matching most descriptions is never held in one window
    w = Window.partitionBy("query_id").orderBy(F.col("updated_at").desc(), F.col("path"))
    top = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    totals = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_hits"))
    return top.join(totals, "query_id").select("query_id", "path", "updated_at", "rank", "total_hits")


def list_descriptions(descriptions: DataFrame, directory: str | None = None) -> DataFrame:
    """FLT-4: descriptions under ``directory`` (exact or below it), newest first."""
    df = descriptions
    if directory:
        d = directory.rstrip("/")
        df = df.filter((F.col("path") == d) | F.col("path").startswith(d + "/"))
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.select("path", "description", "updated_at", total.alias("total"))
            .orderBy(F.col("updated_at").desc(), F.col("path")))


def get_descriptions(descriptions: DataFrame, paths: DataFrame) -> DataFrame:
    """FLT-5: batch GET; unknown paths give NULL description and a message."""
    j = paths.select("path").join(descriptions, "path", "left")
    return j.select("path", "description", "created_at", "updated_at",
                    F.when(F.col("description").isNull(), F.lit("No description set for this path"))
                    .alias("message"))


def lookup_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    """FLT-6: stored category and keywords for a batch of paths (NULL / [] if unknown). Keywords may be
    stored as an array or as JSON text; text that cannot be read gives []."""
    if isinstance(files.schema["keywords"].dataType, StringType):
        files = files.withColumn("keywords", json_array("keywords"))
    j = paths.select("path").join(files.select("path", "category", "keywords"), "path", "left")
    return j.select("path", "category", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


# ----------------------------------------------------------------------------
# AGG-1..5 statistics
# ----------------------------------------------------------------------------

def stats_by_category(files: DataFrame) -> DataFrame:
    return (files.filter(F.col("category").isNotNull()).groupBy("category")
            .agg(F.count(F.lit(1)).alias("file_count"),
                 F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size")))


def stats_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("total_files"),
                     F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size_bytes"),
                     F.count_if(F.col("category") == K.INBOX).alias("inbox_count"))


def top_viewed(files: DataFrame, n: int = K.TOP_VIEWED) -> DataFrame:
    return (files.select("path", "view_count")
            .orderBy(F.col("view_count").desc(), F.col("path")).limit(n))


def category_share(files: DataFrame) -> DataFrame:
    """AGG-4: bar chart numbers: categories other than _inbox/_archive, percent of the
    largest count (unrounded)."""
    s = stats_by_category(files).filter(~F.col("category").isin(K.INBOX, K.ARCHIVE))
    w = Window.partitionBy()
    mx = F.greatest(F.lit(1), F.max("file_count").over(w))
    return s.select("category", "file_count",
                    (F.col("file_count").cast("double") / mx.cast("double") * 100.0).alias("share_pct"))


def sidebar_counts(files: DataFrame, categories: DataFrame) -> DataFrame:
    """AGG-5: _inbox, the active categories (Chinese names, id order), _archive, each
    with its file count (0 when absent)."""
    names = (categories.filter("is_active")
             .select(F.col("name_zh").alias("category"), F.col("id").alias("_sort"), F.lit(1).alias("_grp"))
             .unionByName(categories.sparkSession.createDataFrame(
                 [(K.INBOX, "", 0), (K.ARCHIVE, "", 2)], "category string, _sort string, _grp int")))
    counts = stats_by_category(files).select("category", "file_count")
    w = Window.orderBy("_grp", "_sort")
    return (F.broadcast(names).join(counts, "category", "left")
            .select(F.row_number().over(w).alias("position"), "category",
                    F.coalesce("file_count", F.lit(0).cast("bigint")).alias("file_count")))


# ----------------------------------------------------------------------------
# AGG-6..9 recommendations
# ----------------------------------------------------------------------------

def _display_name() -> F.Column:
    """PRJ-1: original_name, else the last path segment."""
    return F.coalesce(F.nullif(F.col("original_name"), F.lit("")), path_name(F.col("path")))


def rec_important(files: DataFrame, n: int = K.RECOMMEND_LIMIT) -> DataFrame:
    return (files.filter((F.col("importance") > 0) & (F.col("category") != K.ARCHIVE))
            .select("path", "category", _display_name().alias("name"), "importance", "last_accessed")
            .orderBy(F.col("importance").desc(), F.col("last_accessed").asc_nulls_first(), F.col("path"))
            .limit(n))


def rec_discovery(files: DataFrame, n: int = K.RECOMMEND_LIMIT, seed: int = 42) -> DataFrame:
    """AGG-7: never-viewed, not archived files in a seeded pseudo-random order."""
    # seeded, reproducible pseudo-random order (the reference uses ORDER BY RANDOM(), V17)
    key = F.md5(F.concat(F.col("path"), F.lit(f":{seed}")))
    return (files.filter((F.col("view_count") == 0) & (F.col("category") != K.ARCHIVE))
            .select("path", "category", _display_name().alias("name"), "view_count", key.alias("_r"))
            .orderBy("_r", "path").limit(n).drop("_r"))


def rec_overdue(files: DataFrame, n: int = K.RECOMMEND_LIMIT, category: str = K.OVERDUE_CATEGORY) -> DataFrame:
    return (files.filter(F.col("category") == category)
            .select("path", _display_name().alias("name"), "last_accessed")
            .orderBy(F.col("last_accessed").asc_nulls_first(), F.col("path")).limit(n))


def rec_by_category(files: DataFrame, n: int = K.RECOMMEND_LIMIT) -> DataFrame:
    """AGG-9: the "important" list for every category at once (top n per category)."""
    w = Window.partitionBy("category").orderBy(F.col("importance").desc(),
                                               F.col("last_accessed").asc_nulls_first(), F.col("path"))
    return (files.filter((F.col("importance") > 0) & (F.col("category") != K.ARCHIVE))
            .select("category", "path", "importance", "last_accessed", F.row_number().over(w).alias("rank"))
            .filter(F.col("rank") <= n))


# ----------------------------------------------------------------------------
# AGG-10..13 feeds
# ----------------------------------------------------------------------------

def access_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("file_path").agg(F.count(F.lit(1)).alias("views"),
                                        F.max("accessed_at").alias("last_view"))


def apply_access_log(files: DataFrame, log: DataFrame) -> DataFrame:
    """AGG-10: view_count += views, last_accessed = latest view; unknown paths are
    only logged (the left join drops them)."""
    r = access_rollup(log).withColumnRenamed("file_path", "path")
    j = files.join(r, "path", "left")
    return j.select(*[
        (F.col("view_count") + F.coalesce("views", F.lit(0))).alias("view_count") if c == "view_count" else
        F.coalesce("last_view", "last_accessed").alias("last_accessed") if c == "last_accessed" else
        F.col(c) for c in files.columns])


def apply_importance(files: DataFrame, feed: DataFrame) -> DataFrame:
    """AGG-11: last importance per path; unknown paths are inserted with defaults."""
    return upsert(files, feed.select("seq", "path", "importance"))


def apply_star_toggles(files: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-12: each toggle flips ``starred``; parity of the toggle count decides.
    Returns (new files, error rows for unknown paths)."""
    t = feed.groupBy("path").agg(F.count(F.lit(1)).alias("toggles"))
    j = files.join(t, "path", "left")
    flipped = F.when(F.pmod(F.coalesce("toggles", F.lit(0)), F.lit(2)) == 1, ~F.col("starred")).otherwise(
        F.col("starred"))
    new = j.select(*[flipped.alias(c) if c == "starred" else F.col(c) for c in files.columns])
    errors = t.join(files.select("path"), "path", "left_anti").select(
        "path", F.lit("File not found in metadata").alias("error"))
    return new, errors


def apply_descriptions(descriptions: DataFrame, feed: DataFrame) -> DataFrame:
    """AGG-13: feed (seq, path, description, at). Non-empty text upserts (keeps
    created_at, sets updated_at); empty text is a read and changes nothing."""
    sets = feed.filter(F.col("description").isNotNull() & (F.col("description") != ""))
    latest = sets.groupBy("path").agg(F.max_by(F.struct("description", "at"), "seq").alias("_n"),
                                      F.min("at").alias("_first_at"))
    j = descriptions.withColumn("_old", F.lit(True)).join(latest, "path", "full_outer")
    return j.select("path",
                    F.coalesce(F.col("_n.description"), F.col("description")).alias("description"),
                    F.when(F.col("_old").isNull(), F.col("_first_at")).otherwise(F.col("created_at"))
                    .alias("created_at"),
                    F.coalesce(F.col("_n.at"), F.col("updated_at")).alias("updated_at"))


def delete_descriptions(descriptions: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-13 delete: returns (remaining descriptions, per path whether a row existed)."""
    d = deletes.select("path").distinct()
    remaining = descriptions.join(d, "path", "left_anti")
    report = d.join(descriptions.select("path", F.lit(True).alias("_e")), "path", "left").select(
        "path", F.coalesce("_e", F.lit(False)).alias("deleted"))
    return remaining, report
