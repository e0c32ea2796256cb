"""Token ids in Re-Pair compressed shards.

Texts are encoded with the ``tokenizers`` library; an end id closes each document. The rows go in
ascending id order, and each shard of about ``shard_ids`` ids is a grammar of its own: as long as a pair
of ids occurs ``least`` times, pairs become nonterminals, the most frequent first (those within an
eighth of the highest count go together, and where two overlap the more frequent one is replaced).
No nonterminal holds an end id, so each document is a run of symbols. A shard keeps its rules, the
expansion length of each rule and where each document's symbols begin: any document, or any range of
ids, is decoded without the rest.

A shard is one row of a Parquet file in the shared folder, so Spark's own commit protocol makes the
output whole when executors go.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenhand.llm.common import release, scratch_path, ship, slices, table

#: Bytes of text whose distinct pieces are encoded together.
SLICE = 12 << 20
#: Pieces that the tokenizer gets in one string.
JOINED = 100
#: A word's first letters and the rest. The pattern doesn't look back, so the rest is encoded alike wherever it stands.
_LETTERS = r"(?s)^(?P<head>[A-Za-z]+)(?P<tail>[\x00-@\[-`{-\x7f].*)$"
_WHITE = r"[\pZ\s\x0b\x1c-\x1f\x85]"
#: White space beside a space, or at the end: such texts go to the tokenizer as they are.
_IRREGULAR = rf"{_WHITE} | {_WHITE}|^ |{_WHITE}$|<\|"
_ENCODERS: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """Encodes texts by their space-led pieces, each distinct one of a slice of texts once.

    In the byte-level pattern a space after a character that isn't white space always begins a new piece,
    whatever went before. The pieces of all texts of a slice are therefore cut at spaces and encoded
    together; the first token of a piece, and no other, begins with the space, which tells the pieces
    apart. Nor does the pattern join letters with what follows: a new piece's first ASCII letters and its
    rest are encoded apart, each distinct one once. Texts where this doesn't hold (see _IRREGULAR) are
    encoded whole. Up to ``known`` pieces of earlier slices are kept; beyond that, the half that was used
    last.
    """

    def __init__(self, path: str, end: int, known: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.bare = Tokenizer.from_file(path)
        self.bare.model._resize_cache(0)  # for what is encoded once only, where looking it up is lost time
        self.base = self.tokenizer.get_vocab_size()
        self.leads = np.zeros(self.base, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.leads[i] = token.startswith("\u0120")  # how the vocabulary writes a space
        #: Pieces of earlier slices without their space, their ids, how many each has, and the turn of their last use.
        self.known, self.turn, self.words = known, 0, pa.array([], pa.large_string())
        self.flat, self.sizes, self.used = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, texts: list[str], once: bool = False) -> list[list[int]]:
        tokenizer = self.bare if once else self.tokenizer
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, place): where in ids and sizes the ids of " " + word are, for each of the distinct words."""
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(place))
        at = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.turn += 1
        self.used[at[at >= 0]] = self.turn
        if len(self.words) + len(new) > self.known:
            at = self._forget(max(0, self.known // 2 - len(new)), at)
            new = words.filter(pa.array(at < 0))
        flat, sizes = self._encoded(new)
        at[at < 0] = len(self.words) + np.arange(len(new))
        self.words, self.used = pa.concat_arrays([self.words, new]), np.append(self.used, np.full(len(new), self.turn))
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return self.flat, self.sizes, at

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of " " + word for all words, number of ids of each); each distinct head and tail is encoded once."""
        cut = pc.extract_regex(words, _LETTERS)
        two = pc.is_valid(cut)
        heads = pc.if_else(two, pc.struct_field(cut, "head"), words).dictionary_encode()
        tails = pc.struct_field(cut, "tail").filter(two).dictionary_encode()
        n = len(heads.dictionary)
        texts = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, n, JOINED), n), pa.int32()), heads.dictionary)
        flat = _flat(self._ids([" " + x for x in pc.binary_join(texts, pa.scalar(" ", pa.large_string())).to_pylist()], once=True))
        starts = np.flatnonzero(self.leads[flat])
        if len(starts) != n:
            raise ValueError("the tokenizer doesn't begin a piece at each space")
        ends = self._ids(tails.dictionary.to_pylist(), once=True)
        sizes = np.concatenate([np.diff(np.append(starts, len(flat))), np.fromiter(map(len, ends), np.int64, len(ends))])
        flat = np.concatenate([flat, _flat(ends)])
        # the head of each word, and its tail if it has one
        cut_at = two.to_numpy(zero_copy_only=False)
        first = np.arange(len(words)) + np.cumsum(cut_at) - cut_at
        items = np.empty(len(words) + int(cut_at.sum()), np.int64)
        items[first] = heads.indices.to_numpy(zero_copy_only=False)
        items[first[cut_at] + 1] = n + tails.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = sizes[items]
        at = np.repeat((np.cumsum(sizes) - sizes)[items] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return flat[at], np.add.reduceat(size, first) if len(first) else first

    def _forget(self, keep: int, at: np.ndarray) -> np.ndarray:
        """Keep the ``keep`` words that were used last; returns the new places of words for the places ``at``, -1 for none."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[:keep])
        start, size = (np.cumsum(self.sizes) - self.sizes)[kept], self.sizes[kept]
        self.flat = self.flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        moved = np.full(len(self.used) + 1, -1, np.int64)
        moved[kept] = np.arange(len(kept))
        self.words, self.sizes, self.used = self.words.take(pa.array(kept)), size, self.used[kept]
        return moved[at]  # -1 takes the last, which is -1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with an end id after each, number of ids of each); texts: strings without nulls."""
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, _IRREGULAR)
        odd = whole.to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts.filter(pc.invert(whole)), " ")
        coded = cut.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        # a text's first word has no space before it
        led = np.ones(len(which), bool)
        led[first] = False
        used = np.flatnonzero(np.bincount(which[led], minlength=len(coded.dictionary)))
        place = np.zeros(len(coded.dictionary), np.int64)
        flat, sizes, place[used] = self._pieces(coded.dictionary.take(pa.array(used)))
        kept = len(sizes)
        alone = self._ids(coded.dictionary.take(pa.array(which[first])).to_pylist() + texts.filter(whole).to_pylist())
        flat = np.concatenate([flat, _flat(alone), np.array([self.end], np.uint32)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, alone), np.int64, len(alone)), [1]])
        start = np.cumsum(sizes) - sizes
        which = place[which]
        which[first] = kept + np.arange(len(first))
        # items of each text in order, and an end
        count = np.full(len(texts), 2, np.int64)
        count[~odd] = lengths + 1
        last = np.cumsum(count) - 1
        items = np.full(int(count.sum()), -1, np.int64)
        items[last] = len(sizes) - 1
        items[last[odd] - 1] = kept + len(first) + np.arange(int(odd.sum()))
        items[items < 0] = which
        size = sizes[items]
        total = int(size.sum())
        kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        at = np.repeat((start[items] - (np.cumsum(size) - size)).astype(kind), size)
        at += np.arange(total, dtype=kind)
        return flat[at], np.add.reduceat(size, last + 1 - count) if len(count) else count


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids)))


def _grouped(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, count, place): the distinct pairs that begin at ``at`` in ``s``, how many there are of each, and where, pair by pair."""
    one, two = s[at].astype(np.uint64), s[at + 1].astype(np.uint64)
    bits, place_bits = int(s.max()).bit_length(), len(s).bit_length()
    if 2 * bits + place_bits <= 64:  # sorts pairs with their places at once
        wide, low = np.uint64(bits), np.uint64(place_bits)
        key = (((one << wide) | two) << low) | at.astype(np.uint64)
        key.sort()
        code, place = key >> low, (key & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    else:
        wide, code = np.uint64(32), (one << np.uint64(32)) | two
        order = np.argsort(code, kind="stable")
        code, place = code[order], at[order]
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    pairs = code[begin]
    pairs = (pairs >> wide << np.uint64(32)) | (pairs & np.uint64((1 << int(wide)) - 1))
    return pairs, np.diff(np.append(begin, len(code))), place


def _without(at: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """``arrays`` without their places ``at`` (ascending)."""
    if len(at) > 1000:
        kept = np.ones(len(arrays[0]), bool)
        kept[at] = False
        return [x[kept] for x in arrays]
    ends = [*at.tolist(), len(arrays[0])]
    begins = [0, *(at + 1).tolist()]
    return [np.concatenate([x[i:j] for i, j in zip(begins, ends, strict=True)]) for x in arrays]


def _apart(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, key) of positions no two of which are neighbours: by turns the least keys beside which nothing is taken yet."""
    taken = []
    while len(at):
        beside = np.zeros(len(at) + 1, bool)
        beside[1:-1] = at[1:] == at[:-1] + 1
        best = np.ones(len(at), bool)
        best[1:] &= ~beside[1:-1] | (key[1:] < key[:-1])
        best[:-1] &= ~beside[1:-1] | (key[:-1] < key[1:])
        taken.append((at[best] << 32) | key[best])
        left = ~best
        left[1:] &= ~(best[:-1] & beside[1:-1])
        left[:-1] &= ~(best[1:] & beside[1:-1])
        at, key = at[left], key[left]
    both = np.sort(np.concatenate(taken)) if taken else at
    return both >> 32, both & 0xFFFFFFFF


def compress(ids: np.ndarray, end: int, first_symbol: int, least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): Re-Pair of ids until no pair occurs ``least`` times; rule i is what first_symbol + i stands for.

    ``upper`` holds how often the pair that begins at a position occurred when it was last counted. That is
    no less than now, except beside symbols that were given to leftovers later on: these are counted once
    more before the end. A turn counts only positions that may reach ``cut``, an eighth of the highest
    count; it falls when no pair reaches it.
    """
    s, rules = ids.astype(np.uint32), np.empty(0, np.uint64)
    uncounted = np.iinfo(np.int32).max
    upper, cut, again = np.full(len(s), uncounted, np.int32), 0, []
    while len(s) > 1:
        at = np.flatnonzero(upper[:-1] >= cut)
        at = at[(s[at] != end) & (s[at + 1] != end)]
        pairs, count, place = _grouped(s, at)
        top = int(count.max()) if len(count) else 0
        if not cut:
            cut, upper[:] = max(least, top // 8), 0
        upper[at] = 0
        upper[place] = np.repeat(count, count)
        if top < cut:
            if cut > least:
                cut = least if cut < 16 * least else cut // 8
                continue
            given = np.zeros(len(rules), bool)
            given[again] = True
            deep = np.flatnonzero(s >= first_symbol)
            more = deep[given[s[deep] - first_symbol]]
            if not len(more):
                break
            upper[more] = upper[np.maximum(more - 1, 0)] = uncounted
            again = []
            continue
        often = np.flatnonzero(count >= cut)
        often = often[np.argsort(-count[often], kind="stable")]
        rank_of = np.full(len(pairs), -1, np.int64)
        rank_of[often] = np.arange(len(often))
        pairs = pairs[often]
        rank = np.repeat(rank_of, count)
        both = (place[rank >= 0] << 32) | rank[rank >= 0]
        both.sort()
        at, rank = both >> 32, both & 0xFFFFFFFF
        # of overlapping pairs the more frequent is replaced; of a row of one pair the first, third, ...
        beside = np.zeros(len(at) + 1, bool)
        beside[1:-1] = at[1:] == at[:-1] + 1
        new = np.ones(len(at), bool)
        new[1:] = ~beside[1:-1] | (rank[1:] != rank[:-1])
        run = np.flatnonzero(new)
        key = 2 * rank + ((np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) & 1)
        at, rank = _apart(at, key)
        rank >>= 1
        # a pair that was left over in an earlier turn keeps its symbol
        order = np.argsort(rules, kind="stable")
        found = order[np.minimum(np.searchsorted(rules[order], pairs), len(rules) - 1)] if len(rules) else np.zeros(len(pairs), np.int64)
        known = rules[found] == pairs if len(rules) else np.zeros(len(pairs), bool)
        fresh = np.zeros(len(pairs), bool)
        fresh[rank] = True
        fresh &= ~known
        symbol = np.where(known, found, 0)
        symbol[fresh] = len(rules) + np.arange(int(fresh.sum()))
        again += symbol[known].tolist()
        rules = np.concatenate([rules, pairs[fresh]])
        s[at] = (first_symbol + symbol[rank]).astype(np.uint32)
        s, upper = _without(at + 1, s, upper)
        at -= np.arange(len(at))
        upper[at] = uncounted
        upper[np.maximum(at - 1, 0)] = uncounted
    return s, np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


class Grammar:
    """Expands symbols of one shard."""

    def __init__(self, rules: np.ndarray, first_symbol: int, lengths: np.ndarray | None = None):
        self.first = first_symbol
        flat, owner = rules.reshape(-1), np.repeat(np.arange(len(rules)), 2)
        while True:
            deep = flat >= first_symbol
            if not deep.any():
                break
            times = np.where(deep, 2, 1)
            begin = np.cumsum(times) - times
            nxt, deep_at = np.repeat(flat, times), begin[deep]
            nxt[deep_at], nxt[deep_at + 1] = rules[flat[deep] - first_symbol].T
            flat, owner = nxt, np.repeat(owner, times)
        self.flat = flat
        self.lengths = np.bincount(owner, minlength=len(rules)).astype(np.int64)
        if lengths is not None and not np.array_equal(lengths, self.lengths):
            raise ValueError("expansion lengths don't fit the rules")
        self.start = np.cumsum(self.lengths) - self.lengths

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        deep = symbols >= self.first
        out[deep] = self.lengths[symbols[deep] - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.sizes(symbols)
        both = np.concatenate([self.flat, symbols])  # a terminal stands for itself
        begin = np.arange(len(symbols)) + len(self.flat)
        deep = symbols >= self.first
        begin[deep] = self.start[symbols[deep] - self.first]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return both[at]

    def slice(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, from the symbols that hold them only."""
        ends = np.cumsum(self.sizes(symbols))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        base = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - base : stop - base]


SHARD = "part int, seq long, n_ids long, doc_ids array<long>, doc_symbols array<int>, first_symbol long, wide boolean, rules binary, rule_lengths binary, symbols binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 20, partitions: int | None = None) -> None:
    """Write the shards of ``docs`` to ``path``.

    Rows are in ascending id order (null first; rows of one id by a hash of their text). A null text is
    empty and holds the end id only. Other columns are left out; an empty table writes no shard.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "id", "th").sortWithinPartitions("id", "th").select("id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, end)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(tokenizer, end)
        encoder, part, seq = _ENCODERS[key], TaskContext.get().partitionId(), 0
        ids, sizes, names = np.empty(0, np.uint32), np.empty(0, np.int64), []
        for batch in batches:
            for i, j in slices(batch.column(1), SLICE):
                more, count = encoder.encode(batch.column(1).slice(i, j - i))
                ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, count])
                names += batch.column(0).slice(i, j - i).to_pylist()
                ends = np.cumsum(sizes)
                done = 0
                while len(sizes) > done and ends[-1] - (ends[done - 1] if done else 0) >= shard_ids:
                    before = int(ends[done - 1]) if done else 0
                    k = int(np.searchsorted(ends, before + shard_ids)) + 1
                    yield _shard(part, seq, ids[before : ends[k - 1]], sizes[done:k], names[done:k], encoder.base, end)
                    done, seq = k, seq + 1
                if done:
                    ids, sizes, names = ids[ends[done - 1] :], sizes[done:], names[done:]
        if names:
            yield _shard(part, seq, ids, sizes, names, encoder.base, end)

    ordered.mapInArrow(pack, SHARD).write.option("compression", "zstd").mode("overwrite").parquet(path)
    release(spark)


def _shard(part: int, seq: int, ids: np.ndarray, sizes: np.ndarray, names: list, base: int, end: int) -> pa.RecordBatch:
    symbols, rules = compress(ids, end, base)
    narrow = base + len(rules) <= 1 << 16
    kind = np.uint16 if narrow else np.uint32
    grammar = Grammar(rules, base)
    lengths = grammar.lengths
    # no rule spans an end id, so each document begins with a symbol
    before = np.cumsum(grammar.sizes(symbols))
    starts = np.searchsorted(before, np.cumsum(sizes) - sizes, "right").astype(np.int32)
    values = [part, seq, len(ids), names, starts.tolist(), base, not narrow, rules.astype(kind).tobytes(), lengths.astype(np.uint32).tobytes(), symbols.astype(kind).tobytes()]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])


class Shard:
    """A shard row read back; documents and id ranges are decoded by themselves."""

    def __init__(self, row: dict):
        kind = np.uint32 if row["wide"] else np.uint16
        rules = np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.uint32)
        self.grammar = Grammar(rules, row["first_symbol"], np.frombuffer(row["rule_lengths"], np.uint32).astype(np.int64))
        self.symbols = np.frombuffer(row["symbols"], kind).astype(np.uint32)
        self.starts = np.array([*row["doc_symbols"], len(self.symbols)], np.int64)
        self.doc_ids = row["doc_ids"]

    def document(self, i: int) -> np.ndarray:
        return self.grammar.expand(self.symbols[self.starts[i] : self.starts[i + 1]])

    def ids(self, start: int, stop: int) -> np.ndarray:
        return self.grammar.slice(self.symbols, start, stop)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each document)."""
        size = self.grammar.sizes(self.symbols)
        return self.grammar.expand(self.symbols), np.add.reduceat(size, self.starts[:-1])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the shards at ``path``."""
    ship(spark)
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "seq", "n_ids")
    inside = sizes.withColumn("before", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    # one row for each partition of the writer: a bounded number
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    parts = parts.withColumn("base", F.sum("all_ids").over(Window.orderBy("part")) - F.col("all_ids"))
    starts = inside.join(parts, "part").select("part", "seq", (F.col("before") + F.col("base")).alias("shard_start"))
    schema = "part int, seq long, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                ids, n = shard.all()
                ends = np.cumsum(n)
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                cols = [pa.array([row["part"]] * len(n), pa.int32()), pa.array([row["seq"]] * len(n), pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())]
                names = ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = shards.mapInArrow(unpack, schema).join(starts, ["part", "seq"])
    keep = ["doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"]
    return out.select(*keep, *(["ids"] if with_ids else []))


def op2_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
