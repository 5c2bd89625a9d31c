"""Operator 8: byte-level BPE encoding and decoding through a global shuffle of distinct words.

Pre-tokens are exploded with their positions per block of documents (some MB of text): a block
keeps the sequence of its pre-tokens as numbers of its distinct words, and sends those words,
sorted and compressed, to the hash bucket of each word. A bucket gathers the words of all
blocks and encodes each distinct one once; the ids go back to the blocks, where they are put
together by position. Decoding looks every id up in the token-byte table, whose size is the
vocabulary's.

The texts are scanned twice (for the words, for the positions) and are themselves never
shuffled or written: what moves is about the size of the compressed positions. Both scans must
see the same blocks, so ``docs`` must be a table scan or a written table; a checksum of each
block's words is carried along and a difference is an error.

Cases: a null text counts as empty and has no tokens; null identifiers and repeated rows are
kept; any white space, of any kind and anywhere, is encoded like the library does; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import gather, kept, read, slices, texts_of, words_of

#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
#: Bytes of text for each hash bucket of words; a bucket's distinct words are held by one task.
BUCKET_BYTES = 8 << 20


def pattern():
    import public_tokenizers
    return public_tokenizers.PATTERN


def rank_file() -> bytes:
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def packed(**columns) -> bytes:
    """Columns of equal length as a compressed Arrow stream."""
    table = pa.record_batch(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


#: Latin letters, then ASCII punctuation but the apostrophe: two pre-tokens, split in C++.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTERS = "".join(c for c in map(chr, range(256)) if re.match(f"[{_LATIN}]", c))
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_PLAIN = f"^[{_LATIN}]+[!-&(-/:-@\\[-`{{-~]*$"


def splits_plainly(findall) -> bool:
    """Whether a pattern takes letters, with a space before them, and then marks, as two matches."""
    return (findall(" " + _LETTERS + _MARKS) == [" " + _LETTERS, _MARKS] and findall(_LETTERS + _MARKS) == [_LETTERS, _MARKS]
            and all(findall(f"{s}a{m}") == [f"{s}a", m] for s in ("", " ") for m in _MARKS))


def pre_tokens(texts: pa.Array, findall) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(numbers, offsets, words): the pre-tokens of the texts as numbers of distinct words.

    A single space always begins a pre-token, so a text may be cut before its spaces, as long as
    no part is empty or begins or ends with white space; other texts are matched whole. Of the
    distinct parts, those of letters and then marks are split in C++ and the others by the pattern."""
    codes, offsets, parts = words_of(texts)
    plain = pc.match_substring_regex(parts, _PLAIN) if splits_plainly(findall) else pa.array(np.zeros(len(parts), bool))
    is_plain = plain.to_numpy(zero_copy_only=False)
    others = np.flatnonzero(~is_plain)
    other_parts = parts.take(pa.array(others)).to_pylist()
    odd = np.zeros(len(parts), bool)
    odd[others] = [not p or p[0].isspace() or p[-1].isspace() for p in other_parts]
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    whole = np.zeros(len(texts), bool)
    whole[rows[odd[codes]]] = True
    keys = 2 * codes + 1  # odd: after a space
    keys[offsets[:-1]] -= 1
    used = ~whole[rows]
    seen = np.zeros(2 * len(parts), bool)
    seen[keys[used]] = True
    distinct = np.flatnonzero(seen)
    place = np.cumsum(seen) - 1
    # the plain parts: letters after a space, letters, marks
    usual = parts.filter(plain)
    letters = pc.utf8_rtrim(usual, characters=_MARKS).dictionary_encode()
    marks = pc.utf8_ltrim(usual, characters=_LETTERS).dictionary_encode()
    n, m = len(letters.dictionary), len(marks.dictionary)
    nth = np.cumsum(is_plain) - 1
    of = distinct[is_plain[distinct >> 1]]
    letter, mark = letters.indices.to_numpy()[nth[of >> 1]] if n else of, marks.indices.to_numpy()[nth[of >> 1]] if m else of
    has_mark = pc.not_equal(marks.dictionary, "").to_numpy(zero_copy_only=False)[mark] if m else np.zeros(0, bool)
    # the others, and the texts that are not cut
    numbers: dict[str, int] = {}
    text_of = dict(zip(others.tolist(), other_parts))
    found = [[numbers.setdefault(w, len(numbers)) for w in findall(" " + text_of[k >> 1] if k & 1 else text_of[k >> 1])]
             for k in distinct[~is_plain[distinct >> 1]].tolist()]
    found += [[numbers.setdefault(w, len(numbers)) for w in findall(texts[int(i)].as_py())] for i in np.flatnonzero(whole)]
    words = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" ", letters.dictionary.type), letters.dictionary, pa.scalar("", letters.dictionary.type)),
                              letters.dictionary, marks.dictionary, pa.array(list(numbers), letters.dictionary.type)]).dictionary_encode()
    number = words.indices.to_numpy()
    # one entry for each part of a text that is cut, one for each text that is not
    lengths = np.empty(len(distinct) + int(whole.sum()), np.int64)
    by_pattern = np.concatenate([~is_plain[distinct >> 1], np.ones(int(whole.sum()), bool)])
    lengths[np.flatnonzero(~by_pattern)] = 1 + has_mark
    lengths[by_pattern] = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lengths) - lengths
    flat = np.empty(int(lengths.sum()), np.int32)
    first = starts[np.flatnonzero(~by_pattern)]
    flat[first] = number[np.where(of & 1, letter, n + letter)] if n else 0
    flat[first[has_mark] + 1] = number[2 * n + mark[has_mark]] if m else 0
    mask = np.ones(len(flat), bool)
    mask[first] = mask[first[has_mark] + 1] = False
    listed = np.fromiter((n for f in found for n in f), np.int64, int(mask.sum()))
    flat[mask] = number[2 * n + m + listed] if len(listed) else 0
    entry = np.empty(len(codes), np.int64)
    entry[used] = place[keys[used]]
    start_of = np.zeros(len(codes), bool)
    start_of[offsets[:-1]] = True
    entry[start_of & ~used] = len(distinct) + np.arange(whole.sum())
    keep = used | start_of
    entry, rows = entry[keep], rows[keep]
    counts = np.bincount(rows, weights=lengths[entry], minlength=len(texts)).astype(np.int64)
    return _used(gather(flat, starts[entry], lengths[entry]), words.dictionary, np.concatenate([[0], np.cumsum(counts)]))


def _used(numbers: np.ndarray, words: pa.Array, offsets: np.ndarray):
    """Only the words that occur."""
    seen = np.zeros(len(words), bool)
    seen[numbers] = True
    return (np.cumsum(seen) - 1).astype(np.int32)[numbers], offsets, words.filter(pa.array(seen))


def _blocks(batches, match, buckets):
    """(block, checksum, texts' slice, numbers, offsets, words by bucket) of each block; words stand by
    bucket and then sorted, and the numbers follow that order."""
    import regex
    from pyspark import TaskContext
    findall = regex.compile(match).findall
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, limit=BLOCK_BYTES):
            numbers, offsets, words = pre_tokens(texts_of(part), findall)
            coded = words.cast(pa.large_binary())
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in coded.to_pylist()), np.int64, len(coded))
            order = pc.sort_indices(pa.table({"b": bucket, "w": coded}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            ordered = coded.take(pa.array(order))
            yield (block, zlib.crc32(b"\0".join(ordered.to_pylist())), part, place[numbers] if len(numbers) else numbers, offsets, ordered,
                   np.searchsorted(bucket[order], np.arange(buckets + 1)))
            block += 1


def encode_decode(docs: DataFrame, ranks: bytes, match: str, id_col: str = "doc_id", text_col: str = "text",
                  bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    bytes that the ids decode to). ``ranks``: a tiktoken rank file; ``match``: its pattern."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = 1 + int(size // bucket_bytes)
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary file
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def send_words(batches):
        for block, crc, _, _, _, words, cuts in _blocks(batches, match, buckets):
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "block": [block], "crc": [crc],
                                       "words": [packed(w=words[cuts[b]:cuts[b + 1]])]})

    def keep_positions(batches):
        for block, crc, part, numbers, offsets, words, _ in _blocks(batches, match, buckets):
            yield pa.record_batch({"block": [block], "crc": [crc], "n_words": [len(words)],
                                   "docs": [packed(doc_id=part.column("doc_id"), n=pa.array(np.diff(offsets)))],
                                   "numbers": [packed(n=pa.array(numbers, pa.int32()))]})

    def encode(batches):
        """Each distinct word of a bucket once; the rows of a bucket follow one another."""
        import tiktoken
        table = ranks_of(shared.value)
        encoding = tiktoken.Encoding("one word", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
        bucket, known = None, {}
        for batch in batches:
            for b, block, crc, words in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    bucket, known = b, {}
                ids = []
                for w in unpacked(words)["w"].to_pylist():
                    got = known.get(w)
                    if got is None:
                        one = table.get(w)
                        got = known[w] = [one] if one is not None else encoding.encode_ordinary(w.decode())
                    ids.append(got)
                lengths = np.fromiter(map(len, ids), np.int32, len(ids))
                flat = np.fromiter((i for w in ids for i in w), np.int32, int(lengths.sum()))
                yield pa.record_batch({"block": [block], "crc": [crc], "bucket": pa.array([b], pa.int32()),
                                       "lengths": [packed(n=pa.array(lengths))], "ids": [packed(n=pa.array(flat))]})

    def assemble(left, right):
        """The documents of one block: ids by position, and their bytes from the token-byte table."""
        out = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        right = right.sort_by("bucket")
        for crc, n_words, docs_, numbers in zip(*(left.column(c).to_pylist() for c in ("crc", "n_words", "docs", "numbers"))):
            lengths = [unpacked(x)["n"].to_numpy() for x in right.column("lengths").to_pylist()] if right.num_rows else []
            lengths = np.concatenate([np.zeros(0, np.int64), *lengths]).astype(np.int64)
            if len(lengths) != n_words or {crc} != {*right.column("crc").to_pylist(), crc}:
                raise ValueError("the two scans of the documents saw different blocks: docs must be a table scan")
            ids = np.concatenate([np.zeros(0, np.int32), *(unpacked(x)["n"].to_numpy() for x in right.column("ids").to_pylist())])
            starts = np.cumsum(lengths) - lengths
            number = unpacked(numbers)["n"].to_numpy()
            table = unpacked(docs_)
            cuts = np.concatenate([[0], np.cumsum(table["n"].to_numpy())])
            # of each distinct word its ids in decimal, with a comma behind each, and the bytes of its tokens
            token_bytes, decimal = _tables(shared.value)
            flat, ends = ids.tolist(), (starts + lengths).tolist()
            listed = [b"".join([decimal[i] for i in flat[a:b]]) for a, b in zip(starts.tolist(), ends)]
            raw = [b"".join([token_bytes[i] for i in flat[a:b]]) for a, b in zip(starts.tolist(), ends)]
            for doc_id, a, b in zip(table["doc_id"].to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                words = number[a:b].tolist()
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(int(lengths[number[a:b]].sum()))
                out["ids_sha256"].append(hashlib.sha256(b"".join([listed[w] for w in words])[:-1]).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join([raw[w] for w in words])).hexdigest())
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                         "ids_sha256": pa.array(out["ids_sha256"], pa.string()),
                         "decoded_sha256": pa.array(out["decoded_sha256"], pa.string())})

    words = rows.mapInArrow(send_words, "bucket int, block long, crc long, words binary")
    ids = (words.repartition(buckets, "bucket").sortWithinPartitions("bucket")
           .mapInArrow(encode, "block long, crc long, bucket int, lengths binary, ids binary"))
    positions = rows.mapInArrow(keep_positions, "block long, crc long, n_words long, docs binary, numbers binary")
    return positions.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(
        assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _tables(ranks: bytes) -> tuple[list[bytes], list[bytes]]:
    """(the token-byte table, each id in decimal with a comma), by id."""
    def build():
        by_id = {r: t for t, r in ranks_of(ranks).items()}
        n = max(by_id) + 1
        return [by_id.get(i, b"") for i in range(n)], [b"%d," % i for i in range(n)]
    return kept(("byte_bpe", len(ranks)), build)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), rank_file(), pattern())
