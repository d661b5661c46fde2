"""Language-model scores from n-gram tries over all training documents.

The model mixes three orders with Dirichlet priors: a word's share of its pair
context, then of its single-word context, then of the whole training text. The
n-grams are dealt to shards by a hash of their first two words, so a pair, its
counts as a context and all triples on it meet in one shard whatever their
number, and no word's successors have to lie in one place. Each shard becomes an
Elias-Fano trie with one-byte probabilities that is asked for the n-grams of all
documents.

Documents travel in rows of some documents (chunks): each sends its distinct
words, then its distinct n-grams, packed and cut by shard, and gets back the
answers in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vigilake.llm.common import staged
from vigilake.llm.packing import pack, steps, unpack
from vigilake.llm.tokens import mixed, word_hashes
from vigilake.llm.trie import CHANCES, Trie, quantised

CHUNK = 4 << 20  # characters of documents in a row, or one document
SHARD = 2_000_000  # tokens, or distinct words of chunks, that a shard is meant for
LEAST_SHARDS = 64
PRIOR_2, PRIOR_3 = 40.0, 8.0  # weight of the shorter context, in words
END = np.uint64(0x5BD1E9955BD1E995)  # in place of a word's hash, after each text


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is not learned from; those without an id are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _within(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values that rise within groups as differences, the first of each whole."""
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.diff(values, prepend=values[:1] * 0)
    out[first] = values[first]
    return out


def _whole(differences: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(differences, dtype=differences.dtype)
    total = np.concatenate((np.zeros(1, total.dtype), total))
    return total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes)


# --- chunks ----------------------------------------------------------------------

def chunked(docs: DataFrame, held: Column, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for some documents: chunk, ids, held (flags), stream (tokens per
    document and places in words), words (hashes, sorted among words about as
    frequent, and training counts) and how many of both there are. Words of one hash are one word: among a
    thousand million distinct ones, three in a hundred chances of any such pair."""
    kind = docs.schema[id_col].dataType.simpleString()

    def row(ids: list, held: list, texts: list, name: str) -> pa.RecordBatch:
        h, counts = word_hashes(texts)
        h = np.insert(h, np.cumsum(counts), END)
        words, at, many = np.unique(h, return_inverse=True, return_counts=True)
        # Frequent words first, by the size of their counts; then by hash. Places
        # in the stream are small where words are many.
        kind_of = np.frexp(many)[1].max() - np.frexp(many)[1]
        order = np.argsort(kind_of, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        at, words, sizes = place[at], words[order], np.bincount(kind_of)
        learned = np.repeat(~np.array(held, dtype=bool), counts + 1)
        stored = pack(sizes, _within(words, sizes), np.bincount(at[learned], minlength=len(words)))
        return pa.RecordBatch.from_arrays([
            pa.array([name]), pa.array([pa.concat_arrays(ids)], pa.list_(ids[0].type)), pa.array([held], pa.list_(pa.bool_())), pa.array([pack(counts + 1, at)]), pa.array([stored]),
            pa.array([len(h)]), pa.array([len(words)]),
        ], names=["chunk", "ids", "held", "stream", "words", "n_tokens", "n_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, n, made = [], [], [], 0, 0
        for batch in batches:
            for i, (out, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                ids.append(batch.column(0).slice(i, 1))
                held.append(out)
                texts.append(text.as_py())
                n += len(texts[-1] or "")
                if n >= size:
                    yield row(ids, held, texts, f"{TaskContext.get().partitionId()}-{made}")
                    ids, held, texts, n, made = [], [], [], 0, made + 1
        if ids:
            yield row(ids, held, texts, f"{TaskContext.get().partitionId()}-{made}")

    read = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"chunk string, ids array<{kind}>, held array<boolean>, stream binary, words binary, n_tokens long, n_words long")


# --- words -----------------------------------------------------------------------

def _word_questions(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sizes, hashes, counts = unpack(stored.as_py())
                hashes, kind_of = _whole(hashes.astype(np.uint64), sizes), np.repeat(np.arange(len(sizes)), sizes)
                # Ranges of the hash, so that the words of a kind are in order of the shards.
                shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[by], np.arange(shards + 1)).tolist()
                held = [s for s in range(shards) if edges[s + 1] > edges[s]]
                asked = []
                for s in held:
                    own = by[edges[s]:edges[s + 1]]
                    many = np.bincount(kind_of[own], minlength=len(sizes))
                    asked.append(pack(many, _within(hashes[own], many), counts[own]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(asked, pa.binary())], names=["chunk", "shard", "asked"])

    return run


def _word_answers(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(a) for a in rows["asked"]]
        sizes = np.array([len(a[1]) for a in asked])
        hashes = np.concatenate([_whole(a[1].astype(np.uint64), a[0]) for a in asked])
        words, at = np.unique(hashes, return_inverse=True)
        counts = np.bincount(at, np.concatenate([a[2] for a in asked]), len(words)).astype(np.int64)
        # Frequent words get small numbers; 0 is for words never learned.
        number = np.zeros(len(words), dtype=np.int64)
        order = np.lexsort((words, -counts))
        number[order] = np.arange(1, len(words) + 1) * shards + int(rows["shard"].iloc[0])
        number[counts == 0] = 0
        parts = np.split(at, np.cumsum(sizes)[:-1])
        out = pd.DataFrame({"chunk": rows["chunk"], "shard": rows["shard"], "answer": [pack(a[0], number[p], counts[p]) for a, p in zip(asked, parts, strict=True)]})
        out["types"], out["tokens"] = 0, 0
        out.loc[out.index[0], ["types", "tokens"]] = int((counts > 0).sum()), int(counts.sum())
        return out

    return run


# --- n-grams ---------------------------------------------------------------------

@dataclass
class Grams:
    """Distinct n-grams of a chunk whose words were all learned, in order of
    shard and words, and which of them each token ends (-1: none)."""

    first: np.ndarray  # numbers of the words of each pair, 0 before a text
    second: np.ndarray
    count_2: np.ndarray  # in training documents
    weight: np.ndarray  # how often the first word was learned
    shard: np.ndarray
    pair_of: np.ndarray  # the pair that each triple starts with
    third: np.ndarray
    count_3: np.ndarray
    pair_at: np.ndarray
    context_at: np.ndarray  # the pair before each token
    triple_at: np.ndarray


def grams(sizes: np.ndarray, at: np.ndarray, number: np.ndarray, counts: np.ndarray, learned: np.ndarray, texts: int, shards: int) -> Grams:
    """``at`` holds the tokens of documents of ``sizes``, as places in the lists
    ``number`` and ``counts`` of words; ``texts`` documents were learned in all."""
    # Words by number, so that n-grams sorted by place are sorted by number;
    # those never learned come first, then the start of a text.
    order = np.argsort(number, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    none = int((number == 0).sum())
    word = np.where(place[at] >= none, place[at] + 1, -1)
    names, seen, n = np.insert(number[order], none, 0), np.insert(counts[order], none, texts), len(order) + 1
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate(([none], word[:-1]))
    before[starts] = none
    ask = np.flatnonzero((before >= 0) & (word >= 0))
    key, inverse = np.unique(before[ask] * n + word[ask], return_inverse=True)
    first, second = names[key // n], names[key % n]
    shard = (mixed(mixed(first.astype(np.uint64)) + second.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
    by = np.argsort(shard, kind="stable")
    rank = np.empty_like(by)
    rank[by] = np.arange(len(by))
    pair_at = np.full(len(word), -1, dtype=np.int64)
    pair_at[ask] = rank[inverse]
    count_2 = np.bincount(pair_at[(pair_at >= 0) & learned], minlength=len(by))
    context = np.concatenate(([-1], pair_at[:-1]))
    context[starts] = -1
    ask = np.flatnonzero((context >= 0) & (word >= 0))
    triple, inverse = np.unique(context[ask] * n + word[ask], return_inverse=True)
    triple_at = np.full(len(word), -1, dtype=np.int64)
    triple_at[ask] = inverse
    count_3 = np.bincount(triple_at[(triple_at >= 0) & learned], minlength=len(triple))
    return Grams(first[by], second[by], count_2, seen[key // n][by], shard[by], triple // n, names[triple % n], count_3, pair_at, context, triple_at)


def _read(row: dict, texts: int, shards: int) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of a chunk with the answers on its words, and sizes, tokens,
    numbers and counts."""
    sizes, at = unpack(row["stream"])
    told = [unpack(a["answer"]) for a in row["words_told"]]
    # From shard by shard to kind by kind.
    by = np.argsort(np.concatenate([np.repeat(np.arange(len(t[0])), t[0]) for t in told]), kind="stable")
    number, counts = (np.concatenate([t[i] for t in told])[by] for i in (1, 2))
    learned = np.repeat(~np.array(row["held"], dtype=bool), sizes)
    return grams(sizes, at, number, counts, learned, texts, shards), sizes, at, number, counts


def _gram_questions(texts: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            g = _read(row, texts, shards)[0]
            edges = np.searchsorted(g.shard, np.arange(shards + 1))
            edges_3 = np.searchsorted(g.pair_of, edges)
            held = np.flatnonzero(np.diff(edges)).tolist()
            asked = []
            for s in held:
                p, t = slice(edges[s], edges[s + 1]), slice(edges_3[s], edges_3[s + 1])
                first, second = g.first[p], g.second[p]
                start = np.flatnonzero(np.diff(first, prepend=-1))
                n_2 = np.diff(np.append(start, len(first)))
                n_3 = np.bincount(g.pair_of[t] - edges[s], minlength=len(first))
                asked.append(pack(steps(first[start]), g.weight[p][start], n_2, _within(second, n_2), g.count_2[p], n_3, _within(g.third[t], n_3), g.count_3[t]))
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(asked, pa.binary())], names=["chunk", "shard", "asked"])

    return run


def _unpacked(asked: bytes) -> tuple[np.ndarray, ...]:
    """first, second, weight of the first, count; pair_of, third, count."""
    first, weight, n_2, second, count_2, n_3, third, count_3 = unpack(asked)
    first = np.repeat(np.cumsum(first), n_2)
    return first, _whole(second, n_2), np.repeat(weight, n_2), count_2, np.repeat(np.arange(len(n_3)), n_3), _whole(third, n_3), count_3


def learned_trie(first: np.ndarray, second: np.ndarray, weight: np.ndarray, count_2: np.ndarray, pair_of: np.ndarray, third: np.ndarray, count_3: np.ndarray, priors: tuple[float, float] = (PRIOR_2, PRIOR_3)) -> Trie:
    """The trie of the n-grams, sorted and distinct, that training documents
    hold: discounted probabilities, and the weight left to the shorter context."""
    held = count_2 > 0
    place = np.cumsum(held) - 1
    root, pair_of_root = np.unique(first[held], return_inverse=True)
    n_2 = count_2[held].astype(np.float64)
    triple = count_3 > 0
    owner = place[pair_of[triple]]
    return Trie(Trie.laid_out(
        root, pair_of_root, second[held], quantised(n_2 / (weight[held] + priors[0])), quantised(priors[1] / (n_2 + priors[1])),
        owner, third[triple], quantised(count_3[triple] / (n_2[owner] + priors[1]))))


def _gram_answers(priors: tuple[float, float]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [_unpacked(a) for a in rows["asked"]]
        sizes, sizes_3 = np.array([len(a[0]) for a in asked]), np.array([len(a[4]) for a in asked])
        first, second, weight, count_2 = (np.concatenate([a[i] for a in asked]) for i in range(4))
        base = np.cumsum(sizes) - sizes
        pair_of = np.concatenate([a[4] + b for a, b in zip(asked, base, strict=True)])
        third, count_3 = (np.concatenate([a[i] for a in asked]) for i in (5, 6))
        del asked
        names = np.unique(np.concatenate((first, second, third)))
        n = len(names)
        pairs, at_2 = np.unique(np.searchsorted(names, first) * n + np.searchsorted(names, second), return_inverse=True)
        triples, at_3 = np.unique(at_2[pair_of] * n + np.searchsorted(names, third), return_inverse=True)
        known = np.zeros(len(pairs), dtype=np.int64)
        known[at_2] = weight
        first, second, pair_of, third = names[pairs // n], names[pairs % n], triples // n, names[triples % n]
        trie = learned_trie(
            first, second, known, np.bincount(at_2, count_2, len(pairs)).astype(np.int64), pair_of, third, np.bincount(at_3, count_3, len(triples)).astype(np.int64), priors)
        code_2, weight_2, code_3 = trie.search(first, second, pair_of, third)
        parts_2, parts_3 = np.split(at_2, np.cumsum(sizes)[:-1]), np.split(at_3, np.cumsum(sizes_3)[:-1])
        return pd.DataFrame({"chunk": rows["chunk"], "shard": rows["shard"], "answer": [
            pack(code_2[p], weight_2[p], code_3[t]) for p, t in zip(parts_2, parts_3, strict=True)]})

    return run


# --- scores ----------------------------------------------------------------------

def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _scores(tokens: int, types: int, texts: int, shards: int, priors: tuple[float, float], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            g, sizes, at, number, counts = _read(row, texts, shards)
            told = [unpack(a["answer"]) for a in row["grams_told"] or []]
            code_2, weight_2, code_3 = (np.append(np.concatenate([t[i] for t in told]) if told else np.zeros(0, np.int64), 0) for i in range(3))
            starts = np.cumsum(sizes) - sizes
            # Place -1 is the added last one: absent.
            base = (counts[at] + 0.5) / (tokens + 0.5 * (types + 1))
            before = np.concatenate(([0], counts[at][:-1]))
            before[starts] = texts
            chance = CHANCES[code_2[g.pair_at]] + priors[0] / (before + priors[0]) * base
            weight = np.where(weight_2[g.context_at] == 0, 1.0, CHANCES[weight_2[g.context_at]])
            chance = CHANCES[code_3[g.triple_at]] + weight * chance
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], kind), pa.array(row["held"], pa.bool_()), pa.array(sizes),
                pa.array(np.add.reduceat((counts[at] > 0).astype(np.int64), starts)), pa.array(np.full(len(sizes), tokens)),
                pa.array(np.add.reduceat(np.log10(base), starts)), pa.array(np.add.reduceat(np.log10(np.minimum(chance, 1.0)), starts)),
            ], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scored(docs: DataFrame, held: Column, priors: tuple[float, float] = (PRIOR_2, PRIOR_3), size: int = CHUNK, shard: int = SHARD, least_shards: int = LEAST_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, the model being learned from the rows that are not held.

    NULL and empty texts have one token, their end. NULL ids and repeated rows are
    documents like others; without training documents each word has the chance of
    an unknown one. Empty tables give no rows; other columns are not read. A
    document is held whole by one task.
    """
    rows = staged(chunked(docs, held, size, id_col, text_col), "tokens")
    of = rows.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    shards = [max(-(-(n or 0) // shard), least_shards) for n in (of["words"], of["tokens"])]
    asked = rows.select("chunk", "words").mapInArrow(_word_questions(shards[0]), "chunk string, shard int, asked binary")
    told = staged(asked.groupBy("shard").applyInPandas(_word_answers(shards[0]), "chunk string, shard int, answer binary, types long, tokens long"), "words")
    learned = told.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    texts = docs.select(F.coalesce(held, F.lit(False)).alias("held")).where(~F.col("held")).count()

    def together(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "answer"))).alias(name))

    read = rows.select("chunk", "ids", "held", "stream").join(together(told, "words_told"), "chunk")
    asked = read.drop("ids").mapInArrow(_gram_questions(texts, shards[1]), "chunk string, shard int, asked binary")
    answers = asked.groupBy("shard").applyInPandas(_gram_answers(priors), "chunk string, shard int, answer binary")
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = read.join(together(answers, "grams_told"), "chunk", "left")
    return both.mapInArrow(_scores(learned["tokens"], learned["types"], texts, shards[1], priors, to_arrow_type(docs.schema[id_col].dataType)), shape).withColumnRenamed("id", id_col)
