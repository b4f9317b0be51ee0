"""Bounded word contexts around mentions, coreference, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X


def sentence_contexts(sents: DataFrame, words: int = 100) -> DataFrame:
    """``doc_id, sent_idx, before, after``: the last and first ``words`` words of the other
    sentences around each sentence.

    A document's words are one array; a sentence takes two bounded slices of it, by the
    number of words before it. Sentences without words drop out.
    """
    rows = sents.select("doc_id", "sent_idx", X.space_tokens(F.col("sentence")).alias("w")).where(F.size("w") > 0)
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "w"))).alias("s"))
    every, starts = X.flattened(F.transform("s", lambda x: x["w"]))
    docs = docs.select("doc_id", "s", every.alias("every"), starts.alias("starts"))

    def around(x: Column, at: Column) -> Column:
        first = F.greatest(at.cast("int") - words, F.lit(0))
        before = F.slice("every", first + 1, at.cast("int") - first)
        return F.struct(x["sent_idx"].alias("sent_idx"), before.alias("before"), F.slice("every", at.cast("int") + F.size(x["w"]) + 1, F.lit(words)).alias("after"))

    return docs.select("doc_id", F.explode(F.zip_with("s", "starts", around)).alias("x")).select("doc_id", "x.*")


def mention_contexts(mentions: DataFrame, sents: DataFrame, words: int = 100) -> DataFrame:
    """Adds ``left_ctx`` and ``right_ctx`` (at most ``words`` words joined by spaces).

    ``mentions`` has ``doc_id, sent_idx, sentence, start, end`` with sentence offsets.
    """
    around = mentions.join(sentence_contexts(sents, words), ["doc_id", "sent_idx"], "left")
    left = X.space_tokens(F.expr("substring(sentence, 1, start)"))
    right = X.space_tokens(F.expr("substring(sentence, end + 1, length(sentence))"))
    none = F.array().cast("array<string>")
    joined = around.withColumn("left_ctx", F.array_join(X.tail(F.concat(F.coalesce("before", none), left), words), " "))
    joined = joined.withColumn("right_ctx", F.array_join(F.slice(F.concat(right, F.coalesce("after", none)), 1, words), " "))
    return joined.drop("before", "after")


def document_chunks(mentions: DataFrame, size: int = 100) -> DataFrame:
    """Adds ``chunk``: at most ``size`` consecutive mentions of a document each."""
    order = Window.partitionBy("doc_id").orderBy("mention_ord")
    return mentions.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def coreferent_candidates(mentions: DataFrame, persons: DataFrame) -> DataFrame:
    """Snapshot coreference: ``doc_id, mention_ord, n_coref, entity, p``.

    A mention takes the averaged candidates of the other mentions of its document that
    contain it between spaces or edges (its first occurrence counts), differ from it and
    have a person as best candidate. Reads the input candidates only; see
    ``coreference_fold`` for the variant where later mentions see earlier results.
    """
    named = persons.select(F.col("name").alias("_person")).distinct()
    rows = mentions.select("doc_id", "mention_ord", F.lower("mention").alias("m"), "cands")
    people = rows.join(named, F.get("cands", F.lit(0))["entity"] == F.col("_person"), "left_semi")
    a = rows.withColumn("word", F.split("m", " ")[0]).alias("a")
    b = people.withColumn("word", F.explode(F.array_distinct(F.split("m", " ")))).alias("b")
    at = F.expr("locate(a.m, b.m)")
    # What stands between spaces begins with a whole word, so pairs meet by document and word.
    whole = (
        (F.col("a.doc_id") == F.col("b.doc_id"))
        & (F.col("a.word") == F.col("b.word"))
        & (F.col("a.m") != F.col("b.m"))
        & (at > 0)
        & ((at == 1) | (F.expr("substring(b.m, locate(a.m, b.m) - 1, 1)") == " "))
        & ((at + F.length("a.m") - 1 == F.length("b.m")) | (F.expr("substring(b.m, locate(a.m, b.m) + length(a.m), 1)") == " "))
    )
    pairs = a.join(b, whole).select("a.doc_id", "a.mention_ord", F.col("b.cands").alias("cands"))
    n = pairs.groupBy("doc_id", "mention_ord").agg(F.count("*").alias("n_coref"))
    each = pairs.select("doc_id", "mention_ord", F.explode("cands").alias("c")).groupBy("doc_id", "mention_ord", F.col("c.entity").alias("entity")).agg(F.sum("c.p").alias("s"))
    return each.join(n, ["doc_id", "mention_ord"]).select("doc_id", "mention_ord", "n_coref", "entity", (F.col("s") / F.col("n_coref")).alias("p"))


def containers(names: list[str]) -> list[list[int]]:
    """For each of the distinct names, those others that hold it between spaces or edges (its
    first occurrence counts). What stands there is a run of whole words, so the runs of a
    name's words are looked up among the names: no pairs are tried."""
    place = {name: k for k, name in enumerate(names)}
    sizes = sorted({name.count(" ") + 1 for name in names})
    out: list[list[int]] = [[] for _ in names]
    for k, name in enumerate(names):
        words = name.split(" ")
        for size in sizes:
            if size > len(words):
                break
            for part in {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}:
                held = place.get(part)
                if held is None or held == k:
                    continue
                at = name.find(part)
                if (at == 0 or name[at - 1] == " ") and (at + len(part) == len(name) or name[at + len(part)] == " "):
                    out[held].append(k)
    return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several stretches, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _folded(names: list[str | None], starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, shares: np.ndarray, person: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes, entity codes and shares of a document's mentions after the fold.

    A mention's value depends on longer names only: on what mentions before it were given,
    and on the input of those after it. So names are worked off from the longest one, and
    mentions of a name with no changed mention between them share one value. Sums are
    taken in the order of the mentions.
    """
    own: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        if name is not None:
            own.setdefault(name.lower(), []).append(k)
    distinct = list(own)
    rows = [np.asarray(v) for v in own.values()]
    held = containers(distinct)
    new_starts, new_sizes = starts.copy(), sizes.copy()
    changed = np.zeros(len(names), bool)
    pool_codes, pool_shares, room = codes.copy(), shares.copy(), len(codes)

    def is_person(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (n > 0) & person[pool_codes[np.minimum(at, max(room - 1, 0))]] if room else np.zeros(len(at), bool)

    for name in sorted(range(len(distinct)), key=lambda k: -len(distinct[k])):
        if not held[name]:
            continue
        others = np.sort(np.concatenate([rows[k] for k in held[name]]))
        late = np.flatnonzero(changed[others])
        before = np.searchsorted(others[late], rows[name])  # changed ones before each mention
        for n in np.unique(before):
            at, size = starts[others], sizes[others]
            at[late[:n]], size[late[:n]] = new_starts[others[late[:n]]], new_sizes[others[late[:n]]]
            met = is_person(at, size)
            if not met.any():
                continue
            flat = _ragged(at[met], size[met])
            seen, first, entity = np.unique(pool_codes[flat], return_index=True, return_inverse=True)
            p = np.bincount(entity, pool_shares[flat], len(seen)) / met.sum()  # adds in order
            order = np.lexsort((-first, -p))
            if room + len(seen) > len(pool_codes):
                grown = 2 * (room + len(seen))
                pool_codes, pool_shares = np.resize(pool_codes, grown), np.resize(pool_shares, grown)
            pool_codes[room : room + len(seen)], pool_shares[room : room + len(seen)] = seen[order], p[order]
            given = rows[name][before == n]
            new_starts[given], new_sizes[given], changed[given] = room, len(seen), True
            room += len(seen)
    return new_starts, new_sizes, pool_codes[:room], pool_shares[:room]


#: Candidates of an Arrow batch that the fold gives out.
FOLD_CANDIDATES = 200_000


def coreference_fold(mentions: DataFrame, persons: set[str]) -> DataFrame:
    """Exact coreference: each document's mentions in order, every one seeing the
    candidates that its predecessors were given. ``persons`` is a closed list.

    Mentions without a name or candidates take no part with what they lack. A task holds a
    document's names and given candidates; its results leave in bounded batches.
    """
    schema = mentions.schema
    arrow = to_arrow_schema(schema)
    cell = arrow.field("cands").type.value_type

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.take(pa.array(np.argsort(table["mention_ord"].to_numpy(), kind="stable")))
        lists = table["cands"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        flat = lists.flatten()
        entities = pc.struct_field(flat, "entity").dictionary_encode()
        names = entities.dictionary
        known = np.array([x in persons for x in names.to_pylist()] + [False])
        codes = pc.fill_null(entities.indices, len(names)).to_numpy().astype(np.int64)
        shares = pc.struct_field(flat, "p").to_numpy(zero_copy_only=False).astype(float)
        starts = np.cumsum(sizes) - sizes
        at, n, codes, shares = _folded(table["mention"].to_pylist(), starts, sizes, codes, shares, known)
        said = pa.concat_arrays([names, pa.nulls(1, names.type)])
        empty = pc.is_null(lists).to_numpy(zero_copy_only=False) & (n == 0)
        cut, total = [0], np.cumsum(n)
        while cut[-1] < len(n):
            gone = total[cut[-1] - 1] if cut[-1] else 0
            cut.append(min(len(n), max(cut[-1] + 1, int(np.searchsorted(total, gone + FOLD_CANDIDATES, side="right"))), cut[-1] + 10_000))
        for a, b in zip(cut, cut[1:]):
            places = _ragged(at[a:b], n[a:b])
            values = {"entity": said.take(pa.array(codes[places])), "p": pa.array(shares[places]).cast(cell.field("p").type)}
            cells = pa.StructArray.from_arrays([values[f.name].cast(f.type) for f in cell], fields=list(cell))
            offsets = np.concatenate([[0], np.cumsum(n[a:b])]).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(empty[a:b], False)), cells, type=arrow.field("cands").type)
            part = table.slice(a, b - a).combine_chunks()
            yield pa.RecordBatch.from_arrays([own if f == "cands" else _whole(part[f]) for f in arrow.names], arrow.names)

    return mentions.groupBy("doc_id").applyInArrow(fold, schema)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
