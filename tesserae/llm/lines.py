"""Line dedup by a deletion-neighbourhood join (operator 7).

A line is a stretch between newlines; its words are compared, whatever white space is between them. A line is removed if
an earlier line, in the order of (key, line number), has the same words or is within one edit of it. In lines of
`fuzzy_words` words or more an edit changes, adds or leaves out a word; shorter lines are compared by characters, one
space between words, if they have `fuzzy_chars` of them (None: such lines have exact repeats only). So lines without
white space, such as Chinese ones or addresses, have near copies too.

Every line that can have such a partner emits, as hashed keys, itself and each variant with one unit deleted. Equal
variants meet by key; the place of the deletion and the line's length are part of the key, so lines of one length must lack
the unit at the same place, and a variant of n - 1 units counts only against the whole of a line of n - 1 units. A line is
held against the earliest line of its keys alone, so no pairs arise however many lines are alike. Then the edit distance of each line to the
line that it met is verified on their words. Where keys met by chance, all lines of those keys are joined again by
cryptographic digests of their variants. Exact repeats are told by 128 bits, of two unlike hashes.

Before that, lines are screened: within one edit, the first or the second half of a line is equal, so only lines that
share a half with another line emit variants. Lines of fewer than `min_words` words always stay (by default only those
without a word). Null keys keep their text as it is; null texts stay null; empty texts have no lines to remove; rows of
equal key are told apart by their text, and equal rows keep equal results; an empty table gives an empty table. Columns
other than key and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common

MIN_WORDS = 1
FUZZY_WORDS = 10
FUZZY_CHARS = 20
#: Words or characters whose variants are made at once (a longer line is one step of its own).
STEP_UNITS = 200_000
#: Keeps a character apart from a word of the same bytes.
CHARACTER = np.uint64(0xA0761D6478BD642F)
#: Bits of a key that count; tests take fewer, so that keys meet by chance.
KEY_BITS = 64
#: Largest side that is broadcast, by its measured size; beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20


def line_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text, number in its text) of each line."""
    breaks = np.flatnonzero(data == 10)
    begins = np.concatenate((offsets[:-1], breaks + 1))
    text = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1))
    order = np.lexsort((begins, text))
    begins, text = begins[order], text[order]
    ends = offsets[text + 1]
    inner = text[1:] == text[:-1]
    ends[:-1][inner] = begins[1:][inner] - 1
    return begins, ends, text, np.arange(len(text)) - np.searchsorted(text, np.arange(len(offsets) - 1))[text]


def line_units(data: np.ndarray, offsets: np.ndarray, fuzzy: int, by_chars: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(unit hashes, where each line's units begin, text of each line, number of the line in its text, its words, places).

    Units are words; by_chars, they are the characters of lines of fewer than `fuzzy` words. places: (begin, end) of lines,
    (start, end) of words, where each line's words begin."""
    begins, stops, text, number = line_places(data, offsets)
    starts, ends, _ = common.word_spans(data, offsets)
    hashes = common.Spans(data)
    words = hashes.of(starts, ends)
    first = np.searchsorted(starts, np.append(begins, len(data)))
    count = np.diff(first)
    places = (begins, stops, starts, ends, first)
    if not by_chars:
        return words, first, text, number, count, places
    line = np.repeat(np.arange(len(count)), count)
    few = count[line] < fuzzy
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[few]] += 1
    inside[ends[few]] -= 1
    begin = (data & 0xC0) != 0x80
    begin[starts] = True
    char = np.flatnonzero(begin & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    word = np.searchsorted(starts, char, "right") - 1
    chars = common.mix(hashes.of(char, np.minimum(np.append(char[1:], len(data)), ends[word])) ^ CHARACTER)
    gap = np.flatnonzero(few & (np.arange(len(line)) > first[:-1][line]))  # words with one before them in their line
    order = np.argsort(np.concatenate((2 * starts[~few] + 1, 2 * char + 1, 2 * starts[gap])), kind="stable")
    units = np.concatenate((words[~few], chars, np.full(len(gap), CHARACTER)))[order]
    first = np.searchsorted(np.concatenate((line[~few], line[word], line[gap]))[order], np.arange(len(count) + 1))
    return units, first, text, number, count, places


def keyed(h: np.ndarray, kind: np.ndarray | int, n: np.ndarray, bits: int = 64) -> np.ndarray:
    """A join key from a hash, its kind and a length."""
    return common.mix(h ^ common.mix(np.asarray(kind, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))) >> np.uint64(64 - bits)


def identities(data: np.ndarray, places: tuple[np.ndarray, ...], spans: common.Spans, first: np.ndarray, use: np.ndarray) -> np.ndarray:
    """128 bits that identify the words of some lines: a hash of their units, and one of other hashes of their words."""
    _, _, starts, ends, at = places
    words = common.Spans(common.prints(data, starts, ends))
    return np.stack((spans.of(first[use], first[use + 1]), words.of(at[use], at[use + 1])), 1)


def words_of(line: bytes) -> bytes:
    return b" ".join(line.split())


def digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def read_lines(docs: DataFrame, min_words: int, fuzzy: int, fuzzy_chars: int | None) -> DataFrame:
    """(key, tag, line, hash, halves): lines that can be removed or remove others; hash identifies the words."""
    bits = KEY_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches):
            words, first, text, number, count, places = line_units(data, offsets, fuzzy, fuzzy_chars is not None)
            n = np.diff(first)
            use = np.flatnonzero(count >= min_words)
            spans = common.Spans(words)
            names = identities(data, places, spans, first, use)
            a, b, n, text, number, count = first[:-1][use], first[1:][use], n[use], text[use], number[use], count[use]
            longer = np.flatnonzero(count >= fuzzy if fuzzy_chars is None else (count >= fuzzy) | (n >= fuzzy_chars))
            x, y, m = a[longer], b[longer], n[longer]
            parts = []
            for less in (0, 1):  # as a line of its length, and as the longer partner of one with a word less
                p = (m - less) // 2
                parts += [keyed(spans.of(x, x + p), 1, m - less, bits), keyed(spans.of(y - (m - less - p), y), 2, m - less, bits)]
            flat = np.stack(parts, 1).ravel().view(np.int64) if len(longer) else np.zeros(0, np.int64)
            sizes = np.zeros(len(n) + 1, np.int32)
            sizes[1:][longer] = 4
            halves = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(number.astype(np.int32)), common.binaries(names.ravel(), 2 * np.arange(len(names) + 1)), halves], names=["key", "tag", "line", "hash", "halves"])

    return docs.mapInArrow(run, "key long, tag long, line int, hash binary, halves array<long>")


def listed(rows: pa.RecordBatch, text: np.ndarray, name_of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, pa.RecordBatch]:
    """(places, their hash, key and line) of the lines that a column of lists (line, hash) names. A row of equal key and
    other text has other lines."""
    lists = rows.column(1)
    per = lists.value_lengths().fill_null(0).to_numpy()
    flat = lists.flatten()
    doc, line = np.repeat(np.arange(len(per)), per), flat.field(0).to_numpy()
    starts = np.searchsorted(text, np.arange(len(per) + 1))
    there = np.flatnonzero(line < np.diff(starts)[doc])
    at = (starts[doc] + line)[there]
    names = flat.field(1).take(pa.array(there))
    same = (np.frombuffer(b"".join(names.to_pylist()), np.uint64).reshape(-1, 2) == name_of(at)).all(1)
    which = pa.array(there[same])
    return at[same], pa.RecordBatch.from_arrays([names.filter(pa.array(same)), rows.column(2).take(pa.array(doc).take(which)), flat.field(0).take(which)], names=["hash", "key", "line"])


def variants(joined: DataFrame, fuzzy: int, by_chars: bool, strong: bool = False) -> DataFrame:
    """(variant, own, hash, key, line): each listed line's own key and the keys of its deletions of one unit.
    joined: text, lines(line, hash), key.

    own is false for a deletion that only a whole line of that length may meet: two such deletions are two edits apart.
    strong: keys are digests, made one by one."""
    bits = KEY_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches):
            words, first, text, _, _, places = line_units(data, offsets, fuzzy, by_chars)
            spans = common.Spans(words)
            at, heads = listed(rows, text, lambda use: identities(data, places, spans, first, use))  # noqa: B023
            if strong:
                begin, end, *_ = places
                blob = data.tobytes()
                yield from (digests(heads.slice(j, 1), words_of(blob[begin[k] : end[k]]), fuzzy) for j, k in enumerate(at.tolist()))
                continue
            a, b = first[at], first[at + 1]
            n = b - a
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // STEP_UNITS)) + 1):
                yield one_step(spans, a[part], b[part], n[part], heads.take(pa.array(part)))

    def one_step(spans: common.Spans, a: np.ndarray, b: np.ndarray, n: np.ndarray, heads: pa.RecordBatch) -> pa.RecordBatch:
        row, place = np.repeat(np.arange(len(n)), n), common.ragged(np.zeros(len(n), np.int64), n)
        # the hash of a line without one unit: units before it, then units after it
        left, right = spans.of(a[row], a[row] + place), spans.of(a[row] + place + 1, b[row])
        same = keyed(common.mix(left) * np.uint64(5) + right, 3 + place, n[row], bits)
        short = keyed(spans.without(a[row], a[row] + place, b[row]), 0, n[row] - 1, bits)
        out = np.concatenate((keyed(spans.of(a, b), 0, n, bits), same, short)).view(np.int64)
        every = pa.array(np.concatenate((np.arange(len(n)), row, row)))
        return keys_of(pa.array(out), len(n) + len(row), heads.take(every))

    return joined.mapInArrow(run, f"variant {'binary' if strong else 'long'}, own boolean, hash binary, key long, line int")


def keys_of(variant: pa.Array, own: int, heads: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([variant, pa.array(np.arange(len(variant)) < own), *heads.columns], names=["variant", "own", *heads.schema.names])


def units_of(words: bytes, fuzzy: int) -> list:
    """What edits of a line are counted in."""
    parts = words.split(b" ")
    return parts if len(parts) >= fuzzy else list(words.decode("utf-8", "surrogateescape"))


def digests(head: pa.RecordBatch, words: bytes, fuzzy: int) -> pa.RecordBatch:
    """As variants(), for one line, with digests for keys."""
    u = units_of(words, fuzzy)
    kind = "word" if u and isinstance(u[0], bytes) else "character"
    keys = [digest(repr((kind, -1, u)).encode())] + [digest(repr((kind, k, u[:k], u[k + 1 :])).encode()) for k in range(len(u))]
    own = len(keys)
    keys += [digest(repr((kind, -1, u[:k] + u[k + 1 :])).encode()) for k in range(len(u))]
    return keys_of(pa.array(keys, pa.binary()), own, head.take(pa.array(np.zeros(len(keys), np.int64))))


def one_edit(a: list, b: list) -> bool:
    """Whether two sequences are at most one change, addition or omission apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def sized(df: DataFrame, weight: str) -> bool:
    """Whether a staged table is small enough to broadcast."""
    got = df.agg(F.sum(F.expr(weight)).alias("b")).first()["b"]
    return (got or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, weight: str) -> DataFrame:
    return F.broadcast(df) if sized(df, weight) else df


def claims(keys: DataFrame) -> DataFrame:
    """(hash, place, by): for each line of keys the earliest line of one of its variants, if that one is earlier.

    The rows of a variant come together once, and each takes the earliest of them; nothing is joined."""
    together = Window.partitionBy("variant")
    head = F.struct("key", "line", "hash")
    first = F.when(F.col("own"), F.min(head).over(together)).otherwise(F.min(F.when(F.col("own"), head)).over(together))
    met = keys.select("hash", head.alias("head"), first.alias("first")).where("first < head").groupBy("hash").agg(F.min("first").alias("first"))
    return met.select("hash", F.struct("first.key", "first.line").alias("place"), F.col("first.hash").alias("by"))


def able(distinct: DataFrame) -> DataFrame:
    """The hashes of lines that share a half with another line."""
    halves = distinct.where("size(halves) > 0").select("hash", F.explode("halves").alias("half"))
    return halves.select("hash", F.count("*").over(Window.partitionBy("half")).alias("n")).where("n > 1").select("hash").distinct()


def of_text(heads: DataFrame, hashes: DataFrame, base: DataFrame) -> DataFrame:
    """(text, lines, key): the texts that first hold the lines of these hashes."""
    lists = heads.join(hashes, "hash", "left_semi").groupBy("key", "tag").agg(F.collect_list(F.struct("line", "hash")).alias("lines"))
    lists = common.stage(lists, "able")
    return base.join(broadcast_if_small(lists, "32 + 20 * size(lines)"), ["key", "tag"]).select("text", "lines", "key")


def spelt(joined: DataFrame, fuzzy: int, by_chars: bool) -> DataFrame:
    """(hash, words) of listed lines. joined: text, lines(line, hash), key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches):
            units, first, text, _, _, places = line_units(data, offsets, fuzzy, by_chars)
            at, heads = listed(rows, text, lambda use: identities(data, places, common.Spans(units), first, use))  # noqa: B023
            begin, end, *_ = places
            blob = data.tobytes()
            words = [words_of(blob[begin[k] : end[k]]) for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([heads.column(0), pa.array(words, pa.binary())], names=["hash", "words"])

    return joined.mapInArrow(run, "hash binary, words binary")


def verified(met: DataFrame, heads: DataFrame, base: DataFrame, fuzzy: int, by_chars: bool) -> DataFrame:
    """claims() with `right`: whether the two lines are one edit apart, judged by their words."""
    both = met.select("hash").union(met.select(F.col("by").alias("hash"))).distinct()
    both = F.broadcast(both) if sized(met, "200") else both
    words = common.stage(spelt(of_text(heads, both, base), fuzzy, by_chars).dropDuplicates(["hash"]), "words")
    pairs = met.join(words, "hash").join(words.toDF("by", "other"), "by").select("hash", "place", "by", "words", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, y = rows.column(3).to_pylist(), rows.column(4).to_pylist()
            right = []
            for p, q in zip(x, y, strict=True):
                u, v = units_of(p, fuzzy), units_of(q, fuzzy)
                right.append(type(u[0]) is type(v[0]) and one_edit(u, v))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(right, pa.bool_())], names=["hash", "place", "by", "right"])

    return common.stage(pairs.mapInArrow(run, "hash binary, place struct<key:long,line:int>, by binary, right boolean"), "verified")


def dropped(base: DataFrame, min_words: int, fuzzy: int, fuzzy_chars: int | None) -> DataFrame:
    """(key, tag, gone): the numbers of each text's removed lines."""
    lines = common.stage(read_lines(base.where("key is not null"), min_words, fuzzy, fuzzy_chars), "lines")
    distinct = common.stage(lines.groupBy("hash").agg(F.min(F.struct("key", "line", "tag")).alias("head"), F.count("*").alias("times"), F.first("halves").alias("halves")), "distinct")
    heads = distinct.select("hash", "head.key", "head.line", "head.tag")
    keys = common.stage(variants(of_text(heads, able(distinct), base), fuzzy, fuzzy_chars is not None), "variants")
    found = common.stage(claims(keys), "claims")
    checked = verified(found, heads, base, fuzzy, fuzzy_chars is not None)
    wrong = checked.where("not right").select("hash")
    near = checked.where("right").select("hash", F.col("place").alias("first"))
    if not wrong.isEmpty():  # keys that met by chance: their lines once more, by digests
        touched = keys.join(keys.join(wrong, "hash", "left_semi").select("variant").distinct(), "variant", "left_semi").select("hash").distinct()
        again = common.stage(variants(of_text(heads, common.stage(touched, "touched"), base), fuzzy, fuzzy_chars is not None, True), "variants")
        near = near.union(claims(again).join(wrong, "hash", "left_semi").select("hash", F.col("place").alias("first")))
    near = F.broadcast(near) if sized(checked, "100") else near  # at most the rows of checked
    own = F.struct("head.key", "head.line")
    verdict = distinct.join(near, "hash", "left").select("hash", F.least(own, F.coalesce("first", own)).alias("first"), "times", own.alias("head"))
    verdict = common.stage(verdict.where("times > 1 or first < head").select("hash", "first"), "verdict")
    common.discard(keys, found, checked, distinct)
    gone = lines.select("key", "tag", "line", "hash").join(verdict, "hash").where(F.struct("key", "line") > F.col("first"))
    return gone.groupBy("key", "tag").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS, fuzzy_chars: int | None = FUZZY_CHARS) -> DataFrame:
    """docs with the removed lines taken out of the text, and n_lines and n_removed (which replace columns so named)."""
    docs = docs.drop("n_lines", "n_removed")
    common.prepare(docs.sparkSession)
    others = [c for c in docs.columns if c not in (key, text)]
    base = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), F.coalesce(text, F.lit("")).alias("text"))
    gone = common.stage(dropped(base, min_words, fuzzy_words, fuzzy_chars), "gone")
    named = _joined(docs, broadcast_if_small(gone, "32 + 4 * size(gone)"), key, text).withColumn("__lines", F.split(F.col(text), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    out = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)
    count = F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long")
    return named.select(key, out.alias(text), *others, count.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed")).select(*docs.columns, "n_lines", "n_removed")


def _joined(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    named = docs.withColumn("__key", F.col(key).cast("long")).withColumn("__tag", F.xxhash64(F.coalesce(text, F.lit(""))))
    return named.join(gone.toDF("__key", "__tag", "__gone"), ["__key", "__tag"], "left")


def rewritten(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with removed lines taken out of the text; rows that lose lines and have no word left go."""
    kept = [c for c in ("n_lines", "n_removed") if c in docs.columns]
    out = dedup_lines(docs.withColumnsRenamed({c: f"__own_{c}" for c in kept}), key, text)
    out = out.where(F.col("n_removed").eqNullSafe(0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({f"__own_{c}": c for c in kept}).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
