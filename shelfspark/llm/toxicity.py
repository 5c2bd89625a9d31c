"""Operator 6: toxicity by a lexicon that tolerates misspelling, and the words around its hits.

The lexicon is learned from a bounded sample of labelled documents: words that toxic documents
hold far more often than others. Its trie is intersected with a Levenshtein automaton: states
are sets of (trie node, edits so far), made deterministic once, so every distinct word of the
corpus runs through one table, letter by letter, for all words of a slice at the same time.
Every hit is scored in its window of words: hits inside quotation marks or near words of
reporting count apart from bare ones, and hits that stand close together count as such. A
logistic model over these sums gives the score.

Labels are learned from only where crc32 of the identifier mod ``FOLDS`` is not ``HELD_OUT``.
Language, source and identifier are no inputs of a score.

Cases: a null or empty text has the score of a text without hits; null identifiers are not held
out and not learned from; repeated rows are scored each; where the sample holds fewer than ten
documents of either class no lexicon is learned and all scores are the share of toxic ones (0
without labels); an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import read, slices, texts_of, words_of
from shelfspark.llm.logistic import Logistic
from shelfspark.session import cut_lineage

#: Bound of the labelled sample that lexicon and model are learned from: toxic and other documents.
TOXIC, OTHER = 4000, 4000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Most terms of the lexicon.
TERMS = 256
#: A term needs this many toxic documents (or this share, if more), as many pairs of neighbours in
#: them (the words of one passage that copies repeat have one pair), and this ratio of shares.
LEAST, LEAST_SHARE, RATIO = 4, 0.005, 25.0
#: Words on either side of a hit that are its window.
WINDOW = 6
#: Letters written for others in evasive spelling.
FOLD = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
QUOTES = "\"'«»„“”‘’‹›"
REPORTING = {"said", "says", "wrote", "writes", "called", "quote", "quoted", "quoting", "reported", "term", "word", "slur",
             "sagte", "sagt", "schrieb", "nannte", "zitat", "wort", "dit", "écrit", "appelé", "mot", "citation",
             "dijo", "dice", "escribió", "llamó", "palabra", "cita"}


def edits(term: str) -> int:
    """Edits that a term tolerates."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class LexiconAutomaton:
    """The trie of the terms, intersected with the Levenshtein automaton of each term's edits."""

    def __init__(self, terms: list[str], budget=edits):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        depth_budget = [0]  # most edits any term below a node tolerates
        ends: dict[int, int] = {}
        for k, term in enumerate(terms):
            node = 0
            depth_budget[0] = max(depth_budget[0], budget(term))
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    depth_budget.append(0)
                node = children[node][c]
                depth_budget[node] = max(depth_budget[node], budget(term))
            ends[node] = k
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for t in terms for c in t}))}  # 0: any other

        def closed(state: dict[int, int]) -> frozenset:
            """With letters of the term left out; of each node the fewest edits."""
            todo = list(state.items())
            while todo:
                node, e = todo.pop()
                if state.get(node) != e:
                    continue
                for child in children[node].values():
                    if e + 1 <= depth_budget[child] and state.get(child, 99) > e + 1:
                        state[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(state.items())

        first = closed({0: 0})
        number, rows, self.term, self.distance = {first: 1}, [], [-1], [0]  # state 0 is dead
        queue = [first]
        symbols = [None, *sorted(self.letters)]
        for state in queue:
            hit = min(((e, ends[n]) for n, e in state if n in ends and e <= budget(terms[ends[n]])), default=(0, -1))
            self.distance.append(hit[0])
            self.term.append(hit[1])
            # any letter may be extra or stand for another one; the same letter costs nothing
            common: dict[int, int] = {}
            for node, e in state:
                if e + 1 <= depth_budget[node]:
                    common[node] = min(common.get(node, 99), e + 1)
                for child in children[node].values():
                    if e + 1 <= depth_budget[child]:
                        common[child] = min(common.get(child, 99), e + 1)
            row = []
            for c in symbols:
                after = dict(common)
                if c is not None:
                    for node, e in state:
                        child = children[node].get(c)
                        if child is not None and e <= depth_budget[child]:
                            after[child] = min(after.get(child, 99), e)
                if not after:
                    row.append(0)
                    continue
                key = closed(after)
                if key not in number:
                    number[key] = len(number) + 1
                    queue.append(key)
                row.append(number[key])
            rows.append(row)
        self.table = np.array([[0] * len(symbols), *rows], np.int32)
        self.term, self.distance = np.array(self.term), np.array(self.distance)
        self.longest = max((len(t) + budget(t) for t in terms), default=0)

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(term or -1, edits) of each word, all words side by side."""
        term, distance = np.full(len(words), -1), np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        fits = np.flatnonzero((sizes <= self.longest) & (sizes > 0))
        if not len(fits) or not self.terms:
            return term, distance
        sizes = sizes[fits]
        text = np.frombuffer("".join(words[i] for i in fits).encode("utf-32-le"), np.uint32)
        symbol = np.zeros(max(int(text.max()), *map(ord, self.letters)) + 1, np.int32)
        for c, i in self.letters.items():
            symbol[ord(c)] = i
        text = symbol[text]
        starts = np.cumsum(sizes) - sizes
        state = np.ones(len(fits), np.int32)
        alive = np.arange(len(fits))
        for k in range(int(sizes.max())):
            alive = alive[(sizes[alive] > k) & (state[alive] > 0)]
            if not len(alive):
                break
            state[alive] = self.table[state[alive], text[starts[alive] + k]]
        term[fits], distance[fits] = self.term[state], self.distance[state]
        return term, distance


_BARE = ".,;:?!()[]{}<>-*_~|/\\&#%$+=^" + QUOTES
_FOLDED = str.maketrans(FOLD)


def bare(word: str) -> str:
    return word.strip(_BARE).lower()


class Scorer:
    """Features of whole texts, and the model over them."""

    def __init__(self, terms: list[str], weights: list[float]):
        self.automaton = LexiconAutomaton(terms)
        self.weights = np.array([*weights, 0.0])
        self.model: Logistic | None = None
        self.constant = 0.0

    def features(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        for c in "\n\t":
            texts = pc.replace_substring(texts, c, " ")
        codes, offsets, distinct = words_of(texts)
        raw = distinct.to_pylist()
        forms = [bare(w) for w in raw]
        term, distance = self.automaton.match(forms)
        # evasive spelling, where plain reading found nothing
        odd = [i for i, w in enumerate(raw) if term[i] < 0 and len(w) <= 2 * self.automaton.longest and not w.isalpha() and any(c in w for c in FOLD)]
        if odd:
            t, d = self.automaton.match([bare(raw[i].strip(".,;:?" + QUOTES).translate(_FOLDED)) for i in odd])
            term[odd], distance[odd] = t, d + (t >= 0)
        quote = np.fromiter((w[:1] in QUOTES or w.rstrip(".,;:?!")[-1:] in QUOTES if w else False for w in raw), bool, len(raw))
        report = np.fromiter((f in REPORTING for f in forms), bool, len(forms))
        rows = np.repeat(np.arange(n), np.diff(offsets))
        at = np.flatnonzero(term[codes] >= 0)
        row = rows[at]
        weight = self.weights[term[codes[at]]]
        exact = distance[codes[at]] == 0
        # the window of each hit, cut at the ends of its text
        total = lambda flags: np.concatenate([[0], np.cumsum(flags[codes])])
        lo, hi = np.maximum(at - WINDOW, offsets[row]), np.minimum(at + WINDOW + 1, offsets[row + 1])
        quotes, reports, hits = total(quote), total(report), total(term >= 0)
        quoted = (quotes[at + 1] - quotes[lo] > 0) & (quotes[hi] - quotes[at] > 0)
        reported = quoted | (reports[hi] - reports[lo] > 0)
        close = hits[hi] - hits[lo] - 1
        sums = lambda w: np.bincount(row, weights=w, minlength=n)
        return np.column_stack([
            np.minimum(sums(weight * exact * ~reported), 12), np.minimum(sums(weight * ~exact * ~reported), 12),
            np.minimum(sums(weight * reported), 12), np.minimum(sums(close * ~reported), 6),
            sums(exact * ~reported) > 0, sums(~exact * ~reported) > 0])

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.constant)
        return self.model.probability(self.features(texts))


_COUNTED = "word string, clean long, toxic long, around long"


def _counted(batches):
    """mapInArrow over (toxic, text) of the sample. For each word the documents of either class in this slice,
    and in rows of their own the neighbours (as a hash of both) that the word has in toxic ones."""
    for batch in batches:
        for part in slices(batch):
            words: dict[str, list] = {}
            for toxic, text in zip(part.column("toxic").to_pylist(), texts_of(part).to_pylist()):
                line = [w for w in map(bare, text.split()) if w]
                own = {w for w in line if 3 <= len(w) <= 24 and w.isalpha()}
                for w in own:
                    words.setdefault(w, [0, 0, set()])[toxic] += 1
                if toxic:
                    for before, w, after in zip(["", *line], line, [*line[1:], ""]):
                        if w in own:
                            words[w][2].add(zlib.crc32(f"{before} {after}".encode()))
            rows = [(w, c[0], c[1], None) for w, c in words.items()] + [(w, 0, 0, x) for w, c in words.items() for x in c[2]]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                      names=["word", "clean", "toxic", "around"])


def held_out(id_column):
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = (labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
             .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    ids = known.join(rows.select("doc_id").distinct(), "doc_id")
    order = F.xxhash64("doc_id", F.lit(6))
    sample = (ids.where("toxic = 1").orderBy(order).limit(TOXIC).unionAll(ids.where("toxic = 0").orderBy(order).limit(OTHER)))
    # copies would make the words of one text look frequent
    texts = (rows.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])  # TOXIC + OTHER identifiers at most
             .groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))).select("toxic", "text")
    texts = cut_lineage(texts, "toxicity-sample")  # read by tasks only: the driver sees words, then rows of features
    n0, n1 = (texts.where(F.col("toxic") == c).count() for c in (0, 1))
    if min(n0, n1) < 10:
        empty = Scorer([], [])
        empty.constant = n1 / (n0 + n1) if n0 + n1 else 0.0
        return empty
    least = max(LEAST, LEAST_SHARE * n1)
    counted = (texts.mapInArrow(_counted, _COUNTED).groupBy("word", "around").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
               .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count("around").alias("around")))
    ratio = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    found = (counted.where(F.least("toxic", "around") >= least).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO)
             .orderBy(F.desc("toxic"), "word").limit(TERMS).collect())
    scorer = Scorer([r["word"] for r in found], [float(np.log(r["ratio"])) for r in found])
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # the lexicon's table, bounded by TERMS

    def features(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch({"toxic": part.column("toxic"), "x": pa.array(list(shared.value.features(texts_of(part))), pa.list_(pa.float64()))})

    got = texts.mapInArrow(features, "toxic int, x array<double>").toArrow()  # a short row for each document of the sample
    y = got.column("toxic").to_numpy().astype(float)
    x = np.stack(got.column("x").to_pylist()).astype(float)
    share = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # the sample's classes back to the labels' shares
    scorer.model = Logistic(x, y, l2=0.5, weight=weight)
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # the lexicon's table, bounded by TERMS

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = shared.value.score(texts_of(part))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": s,
                                       "predicted": pa.array(s >= threshold).cast(pa.int32())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
