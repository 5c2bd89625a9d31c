"""Category dictionary: bootstrap (SNK-2) and maintenance merges (CAT-1..8).

Every mutating call of the catalogue becomes a pure function
``(state, changes) -> new state``; a change feed carries ``seq`` for order.
The dictionary is a dimension: small, broadcast by the operators that use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import constants as K
from shelfspark.functions.text import detect_language
from shelfspark.operators.ordered import ranked_within

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"

CATEGORY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("name_zh", T.StringType(), False),
    T.StructField("name_en", T.StringType(), False),
    T.StructField("extensions", T.ArrayType(T.StringType()), False),
    T.StructField("sample_count", T.LongType(), False),
    T.StructField("is_active", T.BooleanType(), False),
])

KEYWORD_SCHEMA = T.StructType([
    T.StructField("kw_id", T.LongType(), False),
    T.StructField("category_id", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("locale", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), False),
    T.StructField("source", T.StringType(), False),
])


def seed_category_rows() -> list[tuple]:
    return [(c["id"], i, c["name_zh"], c["name_en"], list(c["extensions"]), 0, True)
            for i, c in enumerate(K.SEED_CATEGORIES)]


def seed_keyword_rows() -> list[tuple]:
    """(category_id, keyword, locale, weight, source) in insertion order."""
    rows = []
    for c in K.SEED_CATEGORIES:
        rows += [(c["id"], kw, "zh", K.SEED_WEIGHT, "seed") for kw in c["keywords_zh"]]
        rows += [(c["id"], kw, "en", K.SEED_WEIGHT, "seed") for kw in c["keywords_en"]]
    return rows


def keyword_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Keyword table from rows in insertion order; kw_id is the insertion rank."""
    return spark.createDataFrame([(i,) + tuple(r) for i, r in enumerate(rows)], KEYWORD_SCHEMA)


def seed_categories(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(seed_category_rows(), CATEGORY_SCHEMA)
    return (df.withColumn("created_at", F.expr(EPOCH))
              .withColumn("updated_at", F.expr(EPOCH)))


def seed_keywords(spark: SparkSession) -> DataFrame:
    return keyword_frame(spark, seed_keyword_rows())


def bootstrap(existing_categories: DataFrame | None, spark: SparkSession,
              existing_keywords: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK-2: seed categories and keywords only when the category table is empty; otherwise
    both tables stay as they are."""
    if existing_categories is not None and existing_categories.head(1):
        return existing_categories, existing_keywords if existing_keywords is not None else keyword_frame(spark, [])
    return seed_categories(spark), seed_keywords(spark)


def localized_name(locale) -> "F.Column":
    """PRJ-2: name_zh for locale zh/auto, else name_en."""
    loc = F.lit(locale) if isinstance(locale, str) else locale
    return F.when(loc.isin("zh", "auto"), F.col("name_zh")).otherwise(F.col("name_en"))


# ----------------------------------------------------------------------------
# CAT-1 / CAT-2 listings
# ----------------------------------------------------------------------------

def keyword_counts(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("category_id").agg(F.count(F.lit(1)).alias("keyword_count"))


def list_categories(categories: DataFrame, keywords: DataFrame, locale: str = "zh") -> DataFrame:
    """CAT-1: active categories with keyword_count, ordered sample_count desc, id."""
    kc = keyword_counts(keywords)
    return (categories.filter("is_active")
            .join(F.broadcast(kc), categories["id"] == kc["category_id"], "left")
            .select("id", localized_name(locale).alias("display_name"), "name_zh", "name_en",
                    F.array_join("extensions", ",").alias("extensions"), "sample_count",
                    F.coalesce("keyword_count", F.lit(0).cast("bigint")).alias("keyword_count"))
            .orderBy(F.col("sample_count").desc(), F.col("id")))


def category_map(categories: DataFrame, locale: str = "zh") -> DataFrame:
    """CAT-2: active categories ordered by id, keyed by display name."""
    return (categories.filter("is_active")
            .select(localized_name(locale).alias("display_name"), "id", "name_zh", "name_en",
                    F.array_join("extensions", ",").alias("extensions"), "sample_count")
            .orderBy("id"))


# ----------------------------------------------------------------------------
# CAT-3 add categories
# ----------------------------------------------------------------------------

def category_slug(name) -> "F.Column":
    """TXT-4: lower, space -> '_', other non [a-z0-9_] -> '_', cut to 32; an empty
    slug or one starting with '_' becomes ``cat_`` + a stable hash of the name."""
    n = F.col(name) if isinstance(name, str) else name
    slug = F.substring(F.regexp_replace(F.replace(F.lower(n), F.lit(" "), F.lit("_")),
                                        "[^a-z0-9_]", "_"), 1, K.SLUG_CAP)
    # stable across processes (the reference's hash() is randomised per process, V14)
    h = F.conv(F.substring(F.md5(F.encode(n, "UTF-8")), 1, 8), 16, 10).cast("bigint")
    hashed = F.concat(F.lit("cat_"), F.pmod(h, F.lit(10000)).cast("string"))
    return F.when((slug == "") | slug.startswith("_"), hashed).otherwise(slug)


def translate_name(name) -> "F.Column":
    """TXT-5: the seven seed names map to English, others stay."""
    n = F.col(name) if isinstance(name, str) else name
    m = F.create_map(*[x for kv in K.NAME_TRANSLATION.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, n), n)


def add_categories(categories: DataFrame, keywords: DataFrame, requests: DataFrame
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CAT-3. ``requests``: seq, name, keywords array<string>, extensions array<string>, locale.

    Returns (new categories, new keywords, result rows with status per request).
    The first request of a new id wins; later ones and existing ids are duplicates.
    """
    req = requests.withColumn("cat_id", category_slug("name"))
    w = Window.partitionBy("cat_id").orderBy("seq")
    req = req.withColumn("_rk", F.row_number().over(w))
    existing = categories.select(F.col("id").alias("cat_id"), F.lit(True).alias("_exists"))
    req = req.join(existing, "cat_id", "left")
    ok = req.filter(F.col("_exists").isNull() & (F.col("_rk") == 1))
    max_ord = categories.select(F.max("ord")).scalar()
    ok = ranked_within(ok, [], ["seq"], rank_col="_nth")
    new_cats = ok.select(
        F.col("cat_id").alias("id"), (F.coalesce(max_ord, F.lit(-1)) + F.col("_nth")).cast("int").alias("ord"),
        F.col("name").alias("name_zh"),
        F.when(F.col("locale") == "zh", translate_name("name")).otherwise(F.col("name")).alias("name_en"),
        F.coalesce("extensions", F.array().cast("array<string>")).alias("extensions"),
        F.lit(0).cast("bigint").alias("sample_count"),
        F.lit(True).alias("is_active"),
        F.expr(EPOCH).alias("created_at"), F.expr(EPOCH).alias("updated_at"))
    max_kw = keywords.select(F.max("kw_id")).scalar()
    new_kws = (ok.select("seq", F.col("cat_id").alias("category_id"),
                         F.posexplode(F.coalesce("keywords", F.array().cast("array<string>"))).alias("pos", "kw"),
                         "locale")
               .select("seq", "pos", "category_id", F.lower(F.trim("kw")).alias("keyword"), "locale",
                       F.lit(K.USER_WEIGHT).alias("weight"), F.lit("user").alias("source"))
               .filter(F.col("keyword") != ""))
    new_kws = (ranked_within(new_kws, [], ["seq", "pos"], rank_col="_nth")
               .withColumn("kw_id", F.coalesce(max_kw, F.lit(-1)) + F.col("_nth")).drop("seq", "pos", "_nth"))
    result = req.select("seq", F.col("cat_id").alias("id"), "name",
                        F.when(F.col("_exists").isNull() & (F.col("_rk") == 1), "added")
                        .otherwise("duplicate").alias("status"),
                        F.size(F.coalesce("keywords", F.array())).alias("keywords_count"))
    return (categories.unionByName(new_cats), keywords.unionByName(new_kws), result)


# ----------------------------------------------------------------------------
# CAT-4 / CAT-5 update, soft delete
# ----------------------------------------------------------------------------

def update_categories(categories: DataFrame, updates: DataFrame) -> DataFrame:
    """CAT-4. ``updates``: seq, id, name_zh, name_en, is_active, extensions, updated_at
    (NULL = field not given). Latest non-null value per field wins; an update with no
    valid field changes nothing."""
    fields = ["name_zh", "name_en", "is_active", "extensions"]
    valid = updates.filter(F.greatest(*[F.col(f).isNotNull() for f in fields]))
    latest = valid.groupBy(F.col("id").alias("_uid")).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias("_" + f) for f in fields],
        F.max("updated_at").alias("_updated_at"))
    j = categories.join(latest, categories["id"] == latest["_uid"], "left")
    return j.select(
        "id", "ord",
        *[F.coalesce("_" + f, f).alias(f) for f in ["name_zh", "name_en"]],
        F.coalesce("_extensions", "extensions").alias("extensions"),
        "sample_count",
        F.coalesce("_is_active", "is_active").alias("is_active"),
        "created_at",
        F.coalesce("_updated_at", "updated_at").alias("updated_at"))


def delete_categories(categories: DataFrame, deletes: DataFrame) -> DataFrame:
    """CAT-5: soft delete (is_active=false) for ids in ``deletes`` (id, deleted_at)."""
    d = deletes.groupBy(F.col("id").alias("_did")).agg(F.max("deleted_at").alias("_at"))
    j = categories.join(d, categories["id"] == d["_did"], "left")
    return j.select("id", "ord", "name_zh", "name_en", "extensions", "sample_count",
                    F.when(F.col("_did").isNotNull(), F.lit(False)).otherwise(F.col("is_active")).alias("is_active"),
                    "created_at", F.coalesce("_at", "updated_at").alias("updated_at"))


# ----------------------------------------------------------------------------
# CAT-6..8 keywords
# ----------------------------------------------------------------------------

def add_keywords(keywords: DataFrame, additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CAT-6. ``additions``: seq, category_id, keyword, locale. Keywords are trimmed and
    lower-cased, blanks skipped, existing (category, keyword, locale) skipped; weight 1.5
    source user. Returns (new keywords, added count per category)."""
    clean = (additions.select("seq", "category_id", F.lower(F.trim("keyword")).alias("keyword"), "locale")
             .filter(F.col("keyword") != ""))
    first = clean.groupBy("category_id", "keyword", "locale").agg(F.min("seq").alias("seq"))
    new = first.join(keywords.select("category_id", "keyword", "locale"),
                     ["category_id", "keyword", "locale"], "left_anti")
    max_kw = keywords.select(F.max("kw_id")).scalar()
    # increasing in seq (insertion order) without a global window
    added = new.select((F.coalesce(max_kw, F.lit(-1)) + 1 + F.col("seq")).alias("kw_id"),
                       "category_id", "keyword", "locale",
                       F.lit(K.USER_WEIGHT).alias("weight"), F.lit("user").alias("source"))
    counts = new.groupBy("category_id").agg(F.count(F.lit(1)).alias("keywords_added"))
    return keywords.unionByName(added), counts


def get_keywords(keywords: DataFrame, category_id: str | None = None) -> DataFrame:
    """CAT-7: keywords of a category (or of all) ordered weight desc, locale."""
    df = keywords if category_id is None else keywords.filter(F.col("category_id") == category_id)
    return (df.select("category_id", "keyword", "locale", "weight", "source")
            .orderBy("category_id", F.col("weight").desc(), "locale", "keyword"))


def remove_keywords(keywords: DataFrame, removals: DataFrame) -> DataFrame:
    """CAT-8: delete (category_id, keyword) in all locales, exact string."""
    return keywords.join(removals.select("category_id", "keyword"), ["category_id", "keyword"], "left_anti")


def active_keywords(categories: DataFrame, keywords: DataFrame) -> DataFrame:
    """Keyword rows of active categories joined with the category order."""
    cats = categories.filter("is_active").select(F.col("id").alias("category_id"), "ord")
    return keywords.join(F.broadcast(cats), "category_id")


def keyword_locale(keywords_array) -> "F.Column":
    """LRN-2: language of the joined keywords, 'zh' when there are none."""
    arr = F.col(keywords_array) if isinstance(keywords_array, str) else keywords_array
    return F.when(F.size(arr) > 0, detect_language(F.array_join(arr, " "))).otherwise(F.lit("zh"))
