"""Exact removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts earlier (a smaller id, or
the same document further left) is removed; strings are judged on the input.

A suffix array of a whole corpus is no Spark job, but strings that can be equal can be brought
together first. Each string picks an anchor inside itself by its bytes alone (``anchors``),
and neighbouring strings mostly share one, which leaves one entry per 35 bytes or so:

1. Each task lists its anchors: a hash of the anchor's bytes, one of the whole stretch of the
   strings that chose it, and the place. Of equal stretches in a batch only the first needs
   to be shuffled, the others are known repeats; so passages or copies that fill a third of the
   rows arrive as one entry per batch. An anchor with over ``HOT`` different stretches in a
   batch is known to repeat, too: one entry says so and the stretches skip this shuffle.
2. Entries meet by anchor. One that stands alone is dropped, equal stretches become
   repeats of their first, and different stretches of one anchor go on to be compared.
3. The stretches to compare are cut out of the texts and dealt by their anchor's bytes. Those of
   an anchor with many are sorted where they are cut out, as in 4, at most ``BUCKET`` bytes
   at a time; the first of each run is dealt on by two hashes of its whole ``length`` bytes, the
   others are repeats.
4. Each shard sorts the suffixes at the starts of its strings in two stages (``suffixes``),
   compares neighbours, and finds runs with a common prefix of ``length``; all but the
   first of each run are repeats. Firsts of runs with equal hashes count as one run.
5. Repeats become byte ranges, collected per document and cut out.

What crosses a shuffle: about 20 bytes per anchor, the different stretches of shared anchors (32
bytes per start where an anchor has many), and the texts twice (to cut stretches, to cut repeats).
A passage in very many different surroundings is one entry per string and ``BUCKET`` bytes in its
group. Stretches, and strings of anchors with many, are told equal by two independent 64-bit hashes.

Defined cases: null text is empty. Rows of one id and text are one document, reported alike.
Texts that share an id count in the order of their hashes, and one after another as parts
of that document for "further left". Texts without an id come after all others, by their hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plantwise.llm.anchors import GRAM, anchors
from plantwise.llm.common import fresh_folder, staged
from plantwise.llm.suffixes import END, common_prefixes, sorted_starts

LENGTH = 100
BUCKET = 8 << 20  # bytes of text per bucket
BATCH = 12 << 20  # bytes of text whose anchors a task lists at a time
HOT = 64
STRING_SHARDS = 8  # shards of single strings per bucket
PART = 31  # a text's number under its id (65,536 at most) is kept above this many bits of its positions
NO_ID = 1 << 62  # texts without an id are numbered by their hashes from here on

ENTRY = {"gram": np.uint64, "context": np.uint64, "doc": np.int64, "first": np.int64, "span": np.uint8, "off": np.uint8, "many": np.uint8}
REPEAT = {"doc": np.int64, "first": np.int64, "span": np.uint8}
STRING = {"low": np.uint64, "high": np.uint64, "doc": np.int64, "position": np.int64}


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, those of equal weight together, which compress well."""
    return values.reshape(-1, 1).view(np.uint8).T.tobytes() if len(values) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed(columns: dict[str, np.ndarray], kinds: dict) -> list[bytes]:
    return [pack(columns[n].astype(k)) for n, k in kinds.items()]


def unpacked(rows: list[list[bytes]], kinds: dict) -> dict[str, np.ndarray]:
    return {n: np.concatenate([unpack(r[i], k) for r in rows] or [np.empty(0, k)]) for i, (n, k) in enumerate(kinds.items())}


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """__doc, __part (position offset of this text under its id) and the columns of ``docs``."""
    print_ = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(print_, 2))
    marked = docs.withColumn("__doc", doc).withColumn("__print", print_)
    texts = marked.select("__doc", "__print").distinct()
    several = texts.groupBy("__doc").agg(F.count("*").alias("n")).where("n > 1").select("__doc")
    number = F.row_number().over(Window.partitionBy("__doc").orderBy("__print")) - 1
    parts = staged(texts.join(several, "__doc", "left_semi").select("__doc", "__print", F.shiftleft(number.cast("long"), PART).alias("__part")),
                   fresh_folder(docs.sparkSession, "suffix-parts"))
    return marked.join(parts, ["__doc", "__print"], "left").withColumn("__part", F.coalesce("__part", F.lit(0).cast("long"))).drop("__print")


def portions(batches):
    """The rows of Arrow batches in portions of about BATCH bytes of text, or of one text."""
    for batch in batches:
        ends = np.cumsum(lengths(batch.column("raw")))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + BATCH, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy(zero_copy_only=False)


def listed(batch: dict[str, list], n_buckets: int):
    """Entries of a batch of (doc, part, bytes) by bucket of the anchor, and, as they wait for no
    other batch, its known repeats and skipping stretches in a bucket that the batch picks."""
    import xxhash

    found = []
    for doc, part, raw in zip(batch["doc"], batch["part"], batch["raw"]):
        gram, context, first, last, place = anchors(np.frombuffer(raw, dtype=np.uint8), LENGTH)
        if len(gram):
            found.append((gram, context, np.full(len(gram), doc), first + part, last - first, place - first))
    if not found:
        return
    gram, context, doc, first, span, off = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((first, doc, context, gram))
    gram, context, doc, first, span, off = (x[order] for x in (gram, context, doc, first, span, off))
    other_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    leads = other_gram | np.concatenate([[True], context[1:] != context[:-1]])
    group = np.cumsum(other_gram) - 1
    many = np.bincount(group, leads)[group] > HOT
    # an anchor with very many stretches: its first entry stands for it, the others go straight on
    enters = leads & (~many | other_gram)
    bucket = (gram >> np.uint64(20)) % np.uint64(n_buckets)
    nothing = packed({n: np.empty(0, k) for n, k in REPEAT.items()}, REPEAT)
    for b in np.unique(bucket[enters]):
        e = (bucket == b) & enters
        entries = {"gram": gram[e], "context": context[e], "doc": doc[e], "first": first[e], "span": span[e], "off": off[e], "many": many[e]}
        yield int(b), packed(entries, ENTRY), nothing, b""
    r, s = ~leads, leads & ~enters
    if r.any() or s.any():
        own = xxhash.xxh64_intdigest(pack(doc[:1]) + pack(first[:1])) % n_buckets
        blank = packed({n: np.empty(0, k) for n, k in ENTRY.items()}, ENTRY)
        yield (own, blank, packed({"doc": doc[r], "first": first[r], "span": span[r]}, REPEAT),
               marks(doc[s], first[s], span[s], off[s], np.full(s.sum(), 2)))


def marks(doc, first, span, off, kind) -> bytes:
    """Instructions (doc, mark) as bytes; kind 0: repeat, 1: compare, 2: compare string by string."""
    mark = (first << 16) | (span.astype(np.int64) << 9) | (off.astype(np.int64) << 2) | kind
    return pack(doc.astype(np.int64)) + pack(mark)


def unmarked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(data) // 2
    return unpack(data[:half], np.int64), unpack(data[half:], np.int64)


def judged(entries: dict[str, np.ndarray], repeats: dict[str, np.ndarray], passed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, mark) instructions from all entries of a bucket."""
    order = np.lexsort((entries["first"], entries["doc"], entries["context"], entries["gram"]))
    e = {n: v[order] for n, v in entries.items()}
    n = len(order)
    docs, out = [repeats["doc"]], [(repeats["first"] << 16) | (repeats["span"].astype(np.int64) << 9)]
    if n:
        other_gram = np.concatenate([[True], e["gram"][1:] != e["gram"][:-1]])
        leads = other_gram | np.concatenate([[True], e["context"][1:] != e["context"][:-1]])
        group = np.cumsum(other_gram) - 1
        stretches = np.bincount(group, leads)[group]
        many = (np.bincount(group, e["many"])[group] > 0) | (stretches > 8 * HOT)
        kind = np.where(~leads, 0, np.where(many, 2, 1))
        told = ~leads | (stretches > 1) | many
        docs.append(e["doc"][told])
        out.append(((e["first"] << 16) | (e["span"].astype(np.int64) << 9) | (e["off"].astype(np.int64) << 2) | kind)[told])
    for data in passed:
        d, m = unmarked(data)
        docs.append(d), out.append(m)
    return np.concatenate(docs), np.concatenate(out)


def by_document(doc: np.ndarray, part: np.ndarray, values: np.ndarray) -> pa.Table:
    """One row per (doc, part) with the list of its values."""
    order = np.lexsort((part, doc))
    doc, part, values = doc[order], part[order], values[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])) if len(doc) else np.empty(0, int)
    offsets = np.concatenate([new, [len(doc)]]).astype(np.int32)
    return pa.table({"doc": doc[new], "part": part[new], "marks": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))})


def cut_out(raw: bytes, part: int, doc: int, found: np.ndarray, n_shards: int):
    """Ranges of the known repeats of one text, and (shard, doc, first, starts, bytes) to compare,
    without a shard where strings are compared one by one."""
    import xxhash

    kind, off, span, first = found & 3, (found >> 2) & 127, (found >> 9) & 127, (found >> 16) - part
    known = kind == 0
    ranges = np.stack([first[known], first[known] + span[known] + LENGTH], axis=1)
    out = []
    for k, o, s, f in zip(kind[~known].tolist(), off[~known].tolist(), span[~known].tolist(), first[~known].tolist()):
        shard = xxhash.xxh64_intdigest(raw[f + o:f + o + GRAM], k) % n_shards if k == 1 else None
        out.append((shard, doc, f + part, s + 1, raw[f:f + s + LENGTH]))
    return ranges, out


def single_strings(stretches: list[tuple], n_shards: int):
    """(doc, position) of the repeats among stretches of (shard, doc, first, starts, bytes), and
    (shard, strings) of the first of each run, by shard of the string."""
    import xxhash

    docs, positions, rows = [], [], []
    ends = np.cumsum([len(x[4]) for x in stretches])
    at = 0
    while at < len(stretches):  # BUCKET bytes at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BUCKET, side="right")))
        _, doc, first, starts, texts = zip(*stretches[at:to])
        at = to
        whole, places, doc, position, lead, later = sorted_runs(np.array(doc), np.array(first), np.array(starts), list(texts))
        docs.append(doc[later]), positions.append(position[later])
        digests = b"".join(xxhash.xxh3_128_digest(whole[p:p + LENGTH]) for p in places[lead].tolist())
        low, high = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2).T
        doc, position = doc[lead], position[lead]
        shard = low % np.uint64(n_shards)
        order = np.lexsort((position, doc, shard))
        edges = np.flatnonzero(np.diff(shard[order])) + 1
        for own in np.split(order, edges):
            rows.append((int(shard[own[0]]), packed({"low": low[own], "high": high[own], "doc": doc[own], "position": position[own]}, STRING)))
    return np.concatenate(docs or [np.empty(0, np.int64)]), np.concatenate(positions or [np.empty(0, np.int64)]), rows


def merged(ranges: np.ndarray) -> np.ndarray:
    """Sorted, maximal, disjoint ranges (n x 2)."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    starts = np.flatnonzero(new)
    return np.stack([ranges[starts, 0], reach[np.concatenate([starts[1:] - 1, [len(ranges) - 1]])]], axis=1)


def by_age(run: np.ndarray, doc: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order by run and age, and there: who leads a run, and who repeats its leader."""
    order = np.lexsort((position, doc, run))
    run, doc, position = run[order], doc[order], position[order]
    lead = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.empty(0, bool)
    # an equal string of the same document and place is the same string
    head = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(run) else np.empty(0, int)
    return order, lead, (doc != doc[head]) | (position != position[head])


def sorted_runs(doc: np.ndarray, first: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> tuple:
    """The joined texts, and of all starts by string and age: place there, document, position,
    whether it leads its run of equal strings and whether it repeats that leader."""
    sizes = np.array([len(t) + 1 for t in texts])
    at = np.concatenate([[0], np.cumsum(sizes)])
    text = np.full(at[-1], END, dtype=np.int16)
    joined = b"\0".join(texts) + b"\0"
    text[:] = np.frombuffer(joined, dtype=np.uint8)
    text[at[1:] - 1] = END
    inside = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = sorted_starts(text, inside < starts[owner], LENGTH)
    prefix = common_prefixes(text, order, LENGTH)
    run = np.cumsum(prefix < LENGTH) if len(order) else order
    o, position = doc[owner[order]], first[owner[order]] + inside[order]
    aged, lead, later = by_age(run, o, position)
    return joined, order[aged], o[aged], position[aged], lead, later


def repeated_strings(strings: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, position) of every single string that stands earlier in this shard."""
    low, high, doc, position = (strings[n] for n in STRING)
    order = np.lexsort((high, low))
    low, high, doc, position = low[order], high[order], doc[order], position[order]
    run = np.cumsum(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[:len(low)])
    aged, _, later = by_age(run, doc, position)
    return doc[aged][later], position[aged][later]


def starts_as_rows(doc: np.ndarray, position: np.ndarray) -> pa.Table:
    """Ranges of the strings at these starts, per (doc, part)."""
    order = np.lexsort((position, doc))
    doc, position = doc[order], position[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (position[1:] > position[:-1] + LENGTH)]) if len(doc) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    ends = position[np.concatenate([heads[1:] - 1, [len(doc) - 1]])] + LENGTH if len(doc) else position
    return as_rows(doc[heads], np.stack([position[heads], ends], axis=1))


def as_rows(doc: np.ndarray, ranges: np.ndarray) -> pa.Table:
    """Ranges per (doc, part) as flat lists of starts and ends, without the part's offset."""
    part = (ranges[:, 0] >> PART) << PART
    flat = ranges - part[:, None]
    table = by_document(np.repeat(doc, 2), np.repeat(part, 2), flat.ravel())
    return table.rename_columns(["doc", "part", "ranges"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, part, ranges): byte ranges to remove, starts and ends alternating, of the keyed texts."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET))
    texts = docs.select(F.col("__doc").alias("doc"), F.col("__part").alias("part"), F.col("__text").cast("binary").alias("raw")).where(
        F.octet_length("raw") >= LENGTH)

    def list_anchors(batches):
        for batch in portions(batches):
            rows = list(listed(batch.to_pydict(), n_buckets))
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([r[0] for r in rows], pa.int32()), "entries": pa.array([r[1] for r in rows], pa.list_(pa.binary())),
                "repeats": pa.array([r[2] for r in rows], pa.list_(pa.binary())), "passed": pa.array([r[3] for r in rows], pa.binary())})

    def judge(key, bucket):
        rows = bucket.to_pydict()
        doc, mark = judged(unpacked(rows["entries"], ENTRY), unpacked(rows["repeats"], REPEAT), rows["passed"])
        return by_document(doc, ((mark >> 16) >> PART) << PART, mark)

    told = (
        texts.mapInArrow(list_anchors, "bucket int, entries array<binary>, repeats array<binary>, passed binary")
        .groupBy("bucket").applyInArrow(judge, "doc bigint, part bigint, marks array<bigint>")
        .groupBy("doc", "part").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    )

    def cut(batches):
        for batch in portions(batches):
            b = batch.to_pydict()
            doc, ranges, out = [], [], []
            for d, part, raw, found in zip(b["doc"], b["part"], b["raw"], b["marks"]):
                known, compare = cut_out(raw, part, d, np.array(found, dtype=np.int64), n_buckets)
                known = merged(known) + part
                doc.append(np.full(len(known), d)), ranges.append(known)
                out += compare
            known = as_rows(np.concatenate(doc), np.concatenate(ranges)) if doc else None
            repeat_doc, repeat_at, strings = single_strings([x for x in out if x[0] is None], STRING_SHARDS * n_buckets)
            if known:
                known = pa.concat_tables([known, starts_as_rows(repeat_doc, repeat_at)])
            out = sorted((x for x in out if x[0] is not None), key=lambda x: x[0])
            shard = [x[0] for x in out]
            at = [i for i in range(len(out)) if i == 0 or shard[i] != shard[i - 1]]
            groups = [out[i:j] for i, j in zip(at, [*at[1:], len(out)])]
            n = known.num_rows if known else 0
            blank, alone = [None] * (len(groups) + len(strings)), [None] * len(strings)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([None] * n + [g[0][0] for g in groups] + [n_buckets + s for s, _ in strings], pa.int32()),
                "doc": pa.array((known["doc"].to_pylist() if n else []) + blank, pa.int64()),
                "part": pa.array((known["part"].to_pylist() if n else []) + blank, pa.int64()),
                "ranges": pa.array((known["ranges"].to_pylist() if n else []) + blank, pa.list_(pa.int64())),
                "stretches": pa.array([None] * n + [[pack(np.array([x[1] for x in g])), pack(np.array([x[2] for x in g])),
                                                     pack(np.array([x[3] for x in g]))] for g in groups] + alone, pa.list_(pa.binary())),
                "texts": pa.array([None] * n + [[x[4] for x in g] for g in groups] + alone, pa.list_(pa.binary())),
                "strings": pa.array([None] * (n + len(groups)) + [s for _, s in strings], pa.list_(pa.binary()))})

    cuts = staged(
        texts.join(told, ["doc", "part"]).select("doc", "part", "raw", "marks").mapInArrow(
            cut, "shard int, doc bigint, part bigint, ranges array<bigint>, stretches array<binary>, texts array<binary>, strings array<binary>"),
        fresh_folder(spark, "suffix-cuts"))

    def sort_shard(key, shard):
        rows = shard.to_pydict()
        if rows["strings"][0] is not None:
            return starts_as_rows(*repeated_strings(unpacked(rows["strings"], STRING)))
        doc, first, starts = (np.concatenate([unpack(s[i], np.int64) for s in rows["stretches"]]) for i in range(3))
        _, _, doc, position, _, later = sorted_runs(doc, first, starts, [t for texts in rows["texts"] for t in texts])
        return starts_as_rows(doc[later], position[later])

    sorted_ = cuts.where("shard IS NOT NULL").select("shard", "stretches", "texts", "strings").groupBy("shard").applyInArrow(
        sort_shard, "doc bigint, part bigint, ranges array<bigint>")
    known = cuts.where("shard IS NULL").select("doc", "part", "ranges")
    return known.unionByName(sorted_).groupBy("doc", "part").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def kept_bytes(raw: bytes, ranges: np.ndarray) -> bytes:
    edges = [0, *ranges.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, removed`` (array of (start, end) byte ranges)``, kept`` (binary)."""
    texts = keyed(docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")), "__id", "__text")
    ranges = repeats(texts)

    @F.arrow_udf("removed array<struct<start:long,end:long>>, kept binary")
    def cut(raws: pa.Array, lists: pa.Array) -> pa.Array:
        removed, kept = [], []
        for raw, flat in zip(raws, lists):
            raw = raw.as_py()
            own = merged(np.array(flat.as_py() or [], dtype=np.int64).reshape(-1, 2))
            removed.append([{"start": a, "end": b} for a, b in own.tolist()])
            kept.append(kept_bytes(raw, own))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(removed, kind), pa.array(kept, pa.binary())], names=["removed", "kept"])

    joined = texts.join(ranges, (F.col("__doc") == F.col("doc")) & (F.col("__part") == F.col("part")), "left")
    return joined.select(F.col("__id").alias(doc_id), cut(F.col("__text").cast("binary"), "ranges").alias("c")).select(doc_id, "c.removed", "c.kept")
