"""Language-model scoring with an Elias-Fano n-gram trie, sharded over the cluster.

Order three, interpolated with Dirichlet smoothing: P(w | a b) = f + g P(w | b), with
f = c(abw) / (c(ab) + MU3), g = MU3 / (c(ab) + MU3), the same one level down, and add-one
probabilities below that.  Every word has a name of its own in all three levels: the most frequent ones, at most
``VOCABULARY``, a number known everywhere, any other its 64-bit hash, which a block lists once and numbers for itself.

No task holds the whole model.  Texts are encoded once, in chunks of about ``CHUNK`` tokens, to a written
table.  A chunk asks each shard (by hash of an n-gram's first two words) for its distinct n-grams and
sends their counts over the training texts along, so asking and counting are one shuffle of packed
blocks; pairs are the contexts of trigrams, so only those that end a text are sent.  A shard adds the counts up, builds its
trie in memory-mapped levels (Elias-Fano pointers and
context-relative successors, probabilities in 8-bit logarithmic steps), finds every asked n-gram by
successor search, and answers with codes.  Chunks and their answers meet again and add up the texts.
Hot words and n-grams are counted per chunk before they move; the number of shards grows with the tokens.

Defined cases: a null or blank text has the end token alone; equal rows are scored and counted each; a null
id is kept and belongs to the training texts; without training texts every count is 0 and the base score is that of
the one possible token; other columns are not read.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import WordHashes, hash_of, lower_words, map_batches, most_frequent, ship
from wayfold.llm.elias_fano import U64, Trie
from wayfold.llm.jaccard_join import mixed
from wayfold.session import materialize

#: Words with a number known everywhere; the start has the next one, and from RARE on a chunk, block or shard numbers its other words by hash.
VOCABULARY, WIDTH = 1 << 18, 32
START, RARE = VOCABULARY, VOCABULARY + 1
END = np.uint64(0)  # the hash that stands for the end token; no word has it but by a chance of 2^-64
CHUNK, SHARD = 500_000, 1_000_000
MU2, MU3 = 300.0, 30.0
#: Probability code k > 0 stands for 10 ** (-(k - 1) * STEP); 0 for nothing.
STEP = 8 / 254
#: A pair that starts with a rare word has the code of count / MOST, as its shard does not know the word's own count.
MOST = 1e8


def code_of(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        k = np.clip(np.round(-np.log10(p) / STEP), 0, 254)
    return np.where(p > 0, k + 1, 0).astype(np.uint8)


ZIP, UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
MASK = U64((1 << WIDTH) - 1)
VALUES = np.concatenate([[0.0], 10 ** (-np.arange(255) * STEP)])


def pack(values: np.ndarray) -> bytes:
    """An integer array, its bytes regrouped by weight so that equal high bytes shrink."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return ZIP.compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(UNZIP.decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "uint64"), dtype=U64)


def word_counts(docs: DataFrame, tokens: int = 4 * CHUNK) -> DataFrame:
    """(word hash, count) over the training texts, the end token included."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, size = WordHashes(), [], 0
        for batch in batches:
            for text in batch["text"]:
                codes = hashes.of(text)
                held += [codes, np.array([END])]
                size += len(codes) + 1
                if size >= tokens:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    return map_batches(docs.where("not held").select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: list[np.ndarray]) -> pd.DataFrame:
    words, counts = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"word": words.view("int64"), "n": counts})


class WordIds(dict):
    """Id of each word, kept for a bounded number of words; words without a number known everywhere are numbered per chunk."""

    def __init__(self, vocabulary: dict[int, int]):
        super().__init__()
        self.vocabulary, self.rare = vocabulary, {}

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        code = hash_of(word)
        found = self.vocabulary.get(code)
        if found is None:
            return self.rare_id(code)
        self[word] = found
        return found

    def rare_id(self, code: int) -> int:
        return self.rare.setdefault(code, RARE + len(self.rare))

    def end(self) -> int:
        found = self.vocabulary.get(int(END))
        return self.rare_id(int(END)) if found is None else found


def encoded(docs: DataFrame, vocabulary: np.ndarray, tokens: int = CHUNK) -> DataFrame:
    """One row per chunk: ids of the texts, their lengths and folds, token ids, the end's id, and the sorted hashes of its rare words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most VOCABULARY numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds({int(h): k for k, h in enumerate(shared.value)})
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for name, held, text in zip(batch["id"], batch["held"], batch["text"]):
                words = lower_words(text)
                codes = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
                rows.append((name, held, np.append(codes, ids.end())))
                size += len(words) + 1
                if size >= tokens:
                    yield _chunk(rows, ids)
                    rows, size = [], 0
        if rows:
            yield _chunk(rows, ids)

    schema = "chunk long, n_texts int, ids binary, nulls binary, held binary, lengths binary, tokens binary, ending long, rare binary"
    return map_batches(docs.select("id", "held", "text"), run, schema).withColumn("chunk", F.monotonically_increasing_id())


def _chunk(rows: list[tuple], ids: WordIds) -> pd.DataFrame:
    null = np.array([pd.isna(r[0]) for r in rows])
    names = np.array([0 if x else int(r[0]) for r, x in zip(rows, null)], dtype="int64")
    tokens = np.concatenate([r[2] for r in rows])
    rare, ids.rare = np.fromiter(ids.rare, dtype=U64, count=len(ids.rare)), {}
    order = np.argsort(rare)
    place = np.empty(len(rare), dtype=np.int64)
    place[order] = np.arange(len(rare)) + RARE
    named = tokens >= RARE
    tokens[named] = place[tokens[named] - RARE]
    return pd.DataFrame({"chunk": [0], "n_texts": [len(rows)], "ids": [names.tobytes()], "nulls": [null.tobytes()],
                         "held": [np.array([r[1] for r in rows], dtype=bool).tobytes()],
                         "lengths": [np.array([len(r[2]) for r in rows], dtype="int64").tobytes()],
                         "tokens": [pack(tokens.astype("uint32"))], "ending": [tokens[-1]], "rare": [pack_sorted(rare[order])]})


def renumbered(ids: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The ids with those of rare words replaced by their new numbers."""
    rare = ids >= RARE
    out = ids.copy()
    out[rare] = names[(ids[rare] - U64(RARE)).astype(np.int64)]
    return out


class Chunk:
    """The n-grams of an encoded chunk: contexts, trigrams, pairs that end a text and rare words, each distinct, in order of
    shard and key, with the shards' bounds; and each token's places among them."""

    def __init__(self, row, shards: int):
        self.n_texts = int(row["n_texts"])
        self.ids, self.nulls = np.frombuffer(row["ids"], "int64"), np.frombuffer(row["nulls"], bool)
        self.held, self.lengths = np.frombuffer(row["held"], bool), np.frombuffer(row["lengths"], "int64")
        self.tokens = unpack(row["tokens"], "uint32").astype(U64)
        self.text_of = np.repeat(np.arange(self.n_texts), self.lengths)
        ends = np.cumsum(self.lengths)
        place = np.arange(len(self.tokens)) - (ends - self.lengths)[self.text_of]
        one, two = np.roll(self.tokens, 1), np.roll(self.tokens, 2)
        one[place < 1] = START
        two[place < 2] = START
        train = ~self.held[self.text_of]
        self.before, self.ends = one, ends - 1
        self.rare, self.ending = unpack_sorted(row["rare"]), U64(row["ending"])
        # what a word is known by in every chunk
        names = lambda ids: renumbered(ids, self.rare)

        spread = lambda keys: mixed(mixed(names(keys >> U64(WIDTH))) + names(keys & MASK))
        self.contexts, at, self.context_cuts = self._dealt(two << U64(WIDTH) | one, shards, spread)
        self.context_of = at
        self.triples, self.triple_of = np.unique(at.astype(U64) << U64(WIDTH) | self.tokens, return_inverse=True)
        self.triple_counts = np.bincount(self.triple_of[train], minlength=len(self.triples))
        self.triple_cuts = np.searchsorted(self.triples >> U64(WIDTH), self.context_cuts)
        self.lasts, self.last_of, self.last_cuts = self._dealt(one[self.ends], shards, lambda k: mixed(mixed(names(k)) + END))
        self.last_counts = np.bincount(self.last_of[~self.held], minlength=len(self.lasts))
        self.is_rare = self.tokens >= RARE
        words, at, self.word_cuts = self._dealt(np.arange(len(self.rare)).astype(U64), shards, lambda k: mixed(self.rare[k.astype(np.int64)]))
        self.words, self.word_place = self.rare[words.astype(np.int64)], at
        self.word_of = at[(self.tokens[self.is_rare] - U64(RARE)).astype(np.int64)]
        self.word_counts = np.bincount(self.word_of[train[self.is_rare]], minlength=len(words))

    @staticmethod
    def _dealt(keys: np.ndarray, shards: int, spread):
        """Distinct keys by shard and key, for each occurrence its place among them, and where each shard's keys start."""
        distinct, at = np.unique(keys, return_inverse=True)
        shard = (spread(distinct) % U64(shards)).astype("int64")
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return distinct[order], place[at], np.searchsorted(shard[order], np.arange(shards + 1))

    def block(self, shard: int) -> tuple | None:
        """The packed request to one shard."""
        cut = lambda cuts: slice(cuts[shard], cuts[shard + 1])
        contexts, lasts, words = self.contexts[cut(self.context_cuts)], self.lasts[cut(self.last_cuts)], cut(self.word_cuts)
        if not (len(contexts) or len(lasts) or words.stop > words.start):
            return None
        triples = self.triples[cut(self.triple_cuts)]
        of, third = (triples >> U64(WIDTH)).astype(np.int64) - self.context_cuts[shard], triples & MASK
        ids = np.concatenate([contexts >> U64(WIDTH), contexts & MASK, third, lasts, np.array([self.ending])])
        used = np.unique(ids[ids >= RARE])
        ids = np.where(ids >= RARE, np.searchsorted(used, ids).astype(U64) + U64(RARE), ids)
        firsts, seconds, third, lasts, ending = np.split(ids, np.cumsum([len(contexts), len(contexts), len(third), len(lasts)]))
        return (pack_sorted(firsts), pack(seconds.astype("uint32")), pack(np.bincount(of, minlength=len(contexts)).astype("uint32")),
                pack(third.astype("uint32")), pack(self.triple_counts[cut(self.triple_cuts)].astype("uint32")),
                pack_sorted(lasts), pack(self.last_counts[cut(self.last_cuts)].astype("uint32")), int(ending[0]),
                pack_sorted(self.rare[(used - U64(RARE)).astype(np.int64)]),
                pack_sorted(self.words[words]), pack(self.word_counts[words].astype("uint32")))


BLOCK = ["firsts", "seconds", "sizes", "thirds", "counts", "lasts", "last_counts", "ending", "rare", "words", "word_counts"]


def requests(chunks: DataFrame, shards: int) -> DataFrame:
    """One packed block of n-grams per chunk and shard that it asks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                chunk = Chunk(row, shards)
                made = [(s, row["chunk"], *b) for s in range(shards) if (b := chunk.block(s))]
                yield pd.DataFrame(made, columns=["shard", "chunk", *BLOCK]).astype({"shard": "int64", "ending": "int64"})

    return map_batches(chunks, run, "shard long, chunk long, " + ", ".join(f"{c} {'long' if c == 'ending' else 'binary'}" for c in BLOCK))


def _merged(keys: list[np.ndarray], counts) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All distinct keys of some blocks, their summed counts, and where each block's keys are among them."""
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([unpack(c, "uint32") for c in counts]), minlength=len(every))
    return every, sums, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


def answer(part: pd.DataFrame, counts_of: np.ndarray) -> pd.DataFrame:
    """The answers of one shard to all its blocks; ``counts_of`` holds how often each id stands before another token."""
    tables = [unpack_sorted(x) for x in part["rare"]]
    rare = np.unique(np.concatenate(tables))  # numbered for this shard
    names = [np.searchsorted(rare, t).astype(U64) + U64(RARE) for t in tables]
    own = lambda column, read: [renumbered(read(x), n) for x, n in zip(part[column], names)]
    narrow = lambda x: unpack(x, "uint32").astype(U64)
    ending = renumbered(np.array(part["ending"].iloc[:1], dtype=U64), names[0])[0]  # the same in all blocks now
    asked = [a << U64(WIDTH) | b for a, b in zip(own("firsts", unpack_sorted), own("seconds", narrow))]
    contexts, at = np.unique(np.concatenate(asked), return_inverse=True)
    at = np.split(at, np.cumsum([len(k) for k in asked])[:-1])
    triples, n3, at3 = _merged([np.repeat(k.astype(U64), unpack(s, "uint32")) << U64(WIDTH) | w
                                for k, s, w in zip(at, part["sizes"], own("thirds", narrow))], part["counts"])
    lasts, n2, at2 = _merged([w << U64(WIDTH) | ending for w in own("lasts", unpack_sorted)], part["last_counts"])
    _, n1, at1 = _merged([unpack_sorted(x) for x in part["words"]], part["word_counts"])

    which = (triples >> U64(WIDTH)).astype(np.int64)
    totals = np.bincount(which, weights=n3, minlength=len(contexts))
    known = totals > 0
    level2 = np.concatenate([contexts[known], lasts[n2 > 0]])
    count2 = np.concatenate([totals[known], n2[n2 > 0]])  # a pair stands as often as a word follows it
    total2 = np.concatenate([totals[known], np.zeros(int((n2 > 0).sum()))])
    order = np.argsort(level2)
    level2, count2, total2 = level2[order], count2[order], total2[order]
    first = (level2 >> U64(WIDTH)).astype(np.int64)
    before = np.where(first >= RARE, MOST, counts_of[np.minimum(first, START)] + MU2)
    code2, more2 = code_of(count2 / before), code_of(MU3 / (total2 + MU3))
    seen = n3 > 0
    code3 = code_of(n3[seen] / (totals[which[seen]] + MU3))
    owner = np.searchsorted(level2, contexts)[which[seen]]
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(level2, triples[seen], WIDTH, code2, more2, code3, owner).mapped(folder)
        every = np.union1d(contexts, lasts)
        at_every = trie.pair(every)
        at_context = at_every[np.searchsorted(every, contexts)]
        of = lambda codes, place, none: np.where(place >= 0, np.append(codes, 0)[place], none).astype(np.uint8)
        pairs = of(trie.codes[0], at_context, 0)
        more = of(trie.codes[1], at_context, 1)  # 1: all mass is passed on
        ends = of(trie.codes[0], at_every[np.searchsorted(every, lasts)], 0)
        codes = of(trie.codes[2], trie.third.find(at_context, triples & trie.mask, which), 0)
        made = [(c, s, pack(pairs[a]), pack(more[a]), pack(codes[a3]), pack(ends[a2]), pack(n1[a1].astype("uint32")))
                for c, s, a, a3, a2, a1 in zip(part["chunk"], part["shard"], at, at3, at2, at1)]
        del trie
    return pd.DataFrame(made, columns=["chunk", "shard", "pairs", "more", "codes", "ends", "words"])


def _gathered(answers: pd.DataFrame, column: str, as_type: str = "uint8") -> np.ndarray:
    return np.concatenate([np.empty(0, dtype=as_type), *(unpack(x, as_type) for x in answers[column])])


def text_scores(row, answers: pd.DataFrame, shards: int, known_counts: np.ndarray, before: np.ndarray, n: int, v: int) -> pd.DataFrame:
    """Sums per text of a chunk."""
    chunk = Chunk(row, shards)
    answers = answers.sort_values("shard")
    whole = n + v + 1
    tokens = chunk.tokens.astype(np.int64)
    counts = _gathered(answers, "words", "uint32")
    count = np.append(known_counts, 0)[np.minimum(tokens, len(known_counts))].astype("float64")
    count[chunk.is_rare] = counts[chunk.word_of]
    single = (count + 1) / whole
    # a pair that ends no text is the context of the next token
    pair = np.append(chunk.context_of[1:], 0)
    first = chunk.before.astype(np.int64)
    stands = before[np.minimum(first, START)]
    rare = first >= RARE
    stands[rare] = counts[chunk.word_place[first[rare] - RARE]]
    f2 = VALUES[_gathered(answers, "pairs")][pair]
    f2[chunk.ends] = VALUES[_gathered(answers, "ends")][chunk.last_of]
    f2[rare] *= MOST / (stands[rare] + MU2)
    f3 = VALUES[_gathered(answers, "codes")][chunk.triple_of]
    g3 = VALUES[_gathered(answers, "more")][chunk.context_of]
    score = np.log10(f3 + g3 * (f2 + MU2 / (stands + MU2) * single))
    sums = lambda x: np.bincount(chunk.text_of, weights=x, minlength=chunk.n_texts)
    out = pd.DataFrame({"id": pd.Series(chunk.ids, dtype="Int64"), "held_out": chunk.held, "n_tokens": chunk.lengths,
                        "n_known": sums(count > 0).astype("int64"), "train_tokens": n,
                        "base_score": sums(np.log10(single)), "score": sums(score)})
    out.loc[chunk.nulls, "id"] = pd.NA
    return out


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY,
          chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), held_out.alias("held"))
    words = materialize(word_counts(docs), "word-counts")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(words, "n", min(vocabulary, VOCABULARY)).toPandas()  # bounded
    top = top.sort_values(["n", "word"], ascending=[False, True])
    known = top["n"].to_numpy(dtype="int64")
    hashes = top["word"].to_numpy(dtype="int64").view("uint64")
    # tokens that come before another one: all but the ends, and the start once per training text
    ends = int(known[hashes == END].sum()) or int(words.where("word = 0").agg(F.sum("n")).first()[0] or 0)
    before = np.concatenate([known, np.zeros(VOCABULARY - len(known)), [ends]]).astype("float64")
    shards = max(1, -(-n // shard))

    chunks = materialize(encoded(docs, hashes, chunk), "chunks")
    shared = spark.sparkContext.broadcast((known, before))
    ship(spark)
    answers = (requests(chunks, shards).groupBy("shard").applyInPandas(
        lambda part: answer(part, shared.value[1]), "chunk long, shard long, pairs binary, more binary, codes binary, ends binary, words binary"))

    def finish(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known, before = shared.value
        parts = [text_scores(row, answers, shards, known, before, n, v) for row in rows.to_dict("records")]
        return pd.concat(parts) if parts else pd.DataFrame(columns=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return (chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInPandas(finish, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
            .withColumnRenamed("id", id_col))
