"""Alignment of two tokenizers over the same text, relationally.

Texts are cut into stretches that no token of either side crosses, so that a stretch's end is a cut and how its tokens lie depends on their lengths alone. Each
distinct form of a stretch (the lengths of both sides' tokens) is aligned once, as rows: its tokens are exploded with their positions; windowed sums of their lengths
give where each ends; the two sides meet by equality of form and end. Ends that both have are cuts, whose running count numbers the groups; between two consecutive
ends of either side lies one token of each, which is a link. Forms are joined to the chunks of text that have them; the tokenizers, and putting ids into the places
of an aligned form, run in Python.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, forget, shuffle_partitions, sliced, stored

#: Files of the two vocabularies, and the folder they are in; None: that of the package public_tokenizers.
BYTE_BPE, PIECE_BPE, FOLDER = "byte_bpe_50k.json", "piece_bpe_32k.model", None
#: Distinct stretches of text, and characters of one, whose tokens a worker remembers.
MEMO, MEMO_CHARS = 100_000, 64
#: Bytes of text worked on at once, new stretches that go to the tokenizers together, and how many of these as one text.
STEP, NEW, TOGETHER = 1 << 20, 4096, 256
#: Bytes of text, and about how many distinct stretches, that share a table of stretches; a longer text stands alone.
CHUNK, UNITS = 1 << 24, 400_000
#: Tokens of forms that a task is dealt, about; it sorts and groups them in memory.
TASK_TOKENS = 1 << 19
#: Where no vocabulary has more ids than numbers of 2 bytes, ids are shuffled as these, less NARROW.
NARROW = 1 << 15
#: Id pairs that may be broadcast with their counts: those of one link in HOT or more, of which there are HOT at most.
HOT = 1 << 17
#: What may stand before a blank without a token's end between them: all that some regular expression takes for white space.
_SPACES = frozenset(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000, 0xFEFF]))
#: Where a blank follows other white space.
_HELD = re.compile(f"[{re.escape(''.join(sorted(_SPACES - {' '})))}] ")


def _place(name: str, folder: str | None) -> str:
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with their tokens' bytes. A text is encoded stretch by stretch, as neither has a token across a blank that follows something else."""

    def __init__(self, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, folder: str | None = FOLDER):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_place(byte_bpe, folder))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=_place(piece_bpe, folder))
        alphabet = _byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [added[i] if i in added else bytes(alphabet[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = tuple(np.array([len(x) for x in of], np.int32) for of in (self.a_bytes, self.b_bytes))
        self.narrow = max(len(self.a_bytes), len(self.b_bytes)) <= 2 * NARROW
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        # Of a stretch the ids of A and of B, 4 bytes each; and the joined bytes where these aren't the blank and the stretch.
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.odd: dict[str, tuple[bytes, bytes]] = {}

    def stretches(self, text: str) -> list[str]:
        """The text cut at each blank after something that isn't white space, without these blanks."""
        if not self.apart:
            return [text]
        if not ("  " in text or text[0] == " " or text[-1] in _SPACES or _HELD.search(text)):  # no stretch holds a blank
            return text.split(" ")
        out, held = [], ""
        for w in text.split(" "):
            if not w or w[-1] in _SPACES:
                held += w + " "
            else:
                out.append(held + w if held else w)
                held = ""
        if held:  # blanks at the end stay with what they follow
            out.append(f"{out.pop()} {held[:-1]}" if out else held[:-1])
        return out

    def ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of A of all these stretches one after another, how many each has, and the same of B. Stretches whose joined bytes aren't the blank and the stretch get into `odd`.

        Stretches are encoded together as a text that is cut into just these; where its bytes or its cuts don't come out, each is encoded alone.
        """
        groups: list[list[str]] = []
        open_ = False
        for x in new:
            alone = not self.apart or not x or x[-1] in _SPACES
            if open_ and not alone and len(groups[-1]) < TOGETHER:
                groups[-1].append(x)
            else:
                groups.append([x])
                open_ = not alone
        texts = [" ".join(g) for g in groups]
        out: tuple[list, ...] = ([], [], [], [])
        own = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for g, t, a, b in zip(groups, texts, own, self.b.encode(texts, num_threads=1), strict=True):
            both, want = (a.ids, b), (" " + t).encode()
            joined = tuple(b"".join(map(of.__getitem__, ids)) for of, ids in zip((self.a_bytes, self.b_bytes), both, strict=True))
            both = tuple(np.array(x, np.int32) for x in both)
            if len(g) == 1:
                counts: tuple = tuple(np.array([len(x)]) for x in both)
                if joined != (want, want):
                    self.odd[t] = joined
            else:
                counts = tuple(self._counts(g, x, of) for x, of in zip(both, self.sizes, strict=True)) if joined == (want, want) else (None, None)
            if any(n is None for n in counts):
                parts = [self.ids([x]) for x in g]
                both, counts = ([np.concatenate([p[k] for p in parts]) for k in at] for at in ((0, 2), (1, 3)))
            for to, x in zip(out, (both[0], counts[0], both[1], counts[1]), strict=True):
                to.append(x)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int32) for x in out)

    @staticmethod
    def _counts(group: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
        """How many of the ids each stretch has, or None if a token crosses a stretch's end."""
        ends, want = np.cumsum(sizes[ids]), np.cumsum(np.array([len(x) if x.isascii() else len(x.encode()) for x in group]) + 1)
        at = np.searchsorted(ends, want, side="right")
        return np.diff(at, prepend=0) if at[0] and (ends[at - 1] == want).all() else None

    def _learn(self, new: list[str]) -> None:
        for lo in range(0, len(new), NEW):
            part = new[lo : lo + NEW]
            a, n, b, m = self.ids(part)
            ends = zip(np.cumsum(n).tolist(), n.tolist(), np.cumsum(m).tolist(), m.tolist(), strict=True)
            self.memo.update((x, (a[p - k : p].tobytes(), b[q - l : q].tobytes())) for x, (p, k, q, l) in zip(part, ends, strict=True))

    def _forget(self, stretches: list[str]) -> None:
        for x in stretches:
            del self.memo[x]
            self.odd.pop(x, None)

    def packed(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids of A and B, 4 bytes each; none where a text is empty or the joined bytes of either aren't the blank and the text."""
        each = [self.stretches(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.odd.clear()
        new = list(dict.fromkeys(x for own in each for x in own if x not in self.memo))
        self._learn(new)
        out = []
        for t, own in zip(texts, each, strict=True):
            if self.odd and not self.odd.keys().isdisjoint(own) and not self._same(t, own):
                out.append((b"", b""))
            else:
                parts = [self.memo[x] for x in own]
                out.append((b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])))
        self._forget([x for x in new if len(x) > MEMO_CHARS])
        return out

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """packed() as lists of ids."""
        return [(array("i", a).tolist(), array("i", b).tolist()) for a, b in self.packed(texts)]

    def _same(self, text: str, own: list[str]) -> bool:
        want = (" " + text).encode()
        return all(b"".join(self.odd[x][k] if x in self.odd else (" " + x).encode() for x in own) == want for k in (0, 1))


def batch_ids(pair: Pair, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, n, ids) of a batch (rid, doc_id, text), ids as tokens() has them, STEP bytes of text at a time; a longer text stands alone."""
    sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
    for lo, hi in sliced([range(n) for n in sizes], STEP):
        b = batch.slice(lo, hi - lo)
        found = pair.packed(b.column("text").to_pylist())
        ends = np.cumsum([0] + [(len(x) + len(y)) // 4 for x, y in found], dtype=np.int32)
        ids = np.frombuffer(b"".join([z for x in found for z in x]), np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array((ids - NARROW).astype(np.int16) if pair.narrow else ids))
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array([len(x) // 4 for x, _ in found], pa.int32()), ids], ["rid", "doc_id", "n", "ids"])


def tokens(docs: DataFrame, narrow: bool, folder: str | None = FOLDER, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(rid, doc_id, n, ids) of each row of docs (doc_id, text): the ids of A, n of them, then those of B; less NARROW, in 2 bytes, where the pair is narrow. rid numbers the rows."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core; threads would each hold memory of their own
        pair = Pair(byte_bpe, piece_bpe, folder)
        for batch in batches:
            yield from batch_ids(pair, batch)

    return base.mapInArrow(run, f"rid long, doc_id long, n int, ids array<{'short' if narrow else 'int'}>")


class _Chunk:
    """The distinct stretches of a run of texts, numbered, with the ids of both sides."""

    def __init__(self) -> None:
        self.units: dict = defaultdict()
        self.units.default_factory = self.units.__len__  # a new one gets the next number
        self.bytes = 0
        self.parts: list[tuple] = []

    def add(self, pair: Pair, texts: list[str]) -> list[np.ndarray]:
        """Of each text the numbers of its stretches; none for one without tokens."""
        known, out = len(self.units), []
        for t in texts:
            own = pair.stretches(t) if t else []
            out.append(np.fromiter(map(self.units.__getitem__, own), np.int32, len(own)))
        new = list(islice(self.units, known, None))
        for lo in range(0, len(new), NEW):
            self.parts.append(pair.ids(new[lo : lo + NEW]))
        for i, t in enumerate(texts if pair.odd else []):
            own = pair.stretches(t) if t else []
            if not pair.odd.keys().isdisjoint(own):
                out[i] = np.array([self._whole(pair, t, own)] if pair._same(t, own) else [], np.int32)
        return out

    def _whole(self, pair: Pair, text: str, own: list[str]) -> int:
        """The number of a text that is the same as a whole, but not stretch by stretch: it is one stretch."""
        if (text,) not in self.units:
            a, n, b, m = pair.ids(own)
            self.parts.append((a, np.array([n.sum()]), b, np.array([m.sum()])))
        return self.units[(text,)]

    def forms(self, pair: Pair) -> tuple[np.ndarray, list[int], list[int], list[int], list[np.ndarray]]:
        """(ids, form, n, m, sizes): the ids of each stretch in order, A's before B's, and the number of its form, -1 where it is in no text with tokens; of the distinct forms how many tokens are A's and how many B's, and the sizes of both."""
        a, n, b, m = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, np.int32) for k in range(4))
        odd = np.zeros(len(n), bool)
        odd[[self.units[x] for x in pair.odd if x in self.units]] = True
        if odd.any():
            a, b, n, m = a[~np.repeat(odd, n)], b[~np.repeat(odd, m)], np.where(odd, 0, n), np.where(odd, 0, m)
        to = np.cumsum(n + m)
        ids, sizes = np.empty(len(a) + len(b), np.int32), np.empty(len(a) + len(b), np.int32)
        for x, k, first, of in ((a, n, to - n - m, pair.sizes[0]), (b, m, to - m, pair.sizes[1])):
            at = np.arange(len(x)) + np.repeat(first - _starts(k), k)
            ids[at], sizes[at] = x, of[x]
        raw, forms, form, lo = sizes.tobytes(), {}, [], 0
        for hi, k in zip((to * 4).tolist(), n.tolist(), strict=True):
            form.append(forms.setdefault((k, raw[lo:hi]), len(forms)) if k else -1)
            lo = hi
        return ids, form, [k for k, _ in forms], [len(x) // 4 - k for k, x in forms], [np.frombuffer(x, np.int32) for _, x in forms]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) for x in parts], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)).cast(kind))


def _coded_schema(narrow: bool) -> str:
    return f"chunk long, rid long, doc_id long, low array<short>, high array<short>, ids array<{'short' if narrow else 'int'}>, form array<int>, form_n array<int>, form_m array<int>, sizes array<array<int>>"


def coded(pair: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_coded_schema` of batches (rid, doc_id, text): one for each text with its stretches' numbers (low: their lower 16 bits, less 32768; high: the others, nearly all 0), and one for each chunk with its table of stretches, where rid, doc_id, low and high are null."""
    names = ["chunk", "rid", "doc_id", "low", "high", "ids", "form", "form_n", "form_m", "sizes"]
    id_type, ints, shorts = pa.int16() if pair.narrow else pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int16())
    rest = [pa.list_(id_type), ints, ints, ints, pa.list_(ints)]
    chunk, own = None, _Chunk()

    def table() -> pa.RecordBatch:
        ids, *whole, sizes = own.forms(pair)
        one = [_lists([ids - NARROW if pair.narrow else ids], id_type), *(_lists([np.array(x, np.int32)], pa.int32()) for x in whole)]
        one.append(pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), _lists(sizes, pa.int32())))
        pair.odd.clear()
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), shorts, shorts)), *one], names)

    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
        for lo, hi in sliced([range(n) for n in sizes], STEP):
            b, size = batch.slice(lo, hi - lo), sum(sizes[lo:hi])
            if chunk is not None and (own.bytes + size > CHUNK or len(own.units) > UNITS):
                yield table()
                chunk, own = None, _Chunk()
            if chunk is None:
                chunk = b.column("rid")[0].as_py()
            own.bytes += size
            units = own.add(pair, b.column("text").to_pylist())
            both = (_lists([f(x) for x in units], pa.int16()) for f in (lambda x: (x & 0xFFFF) - NARROW, lambda x: x >> 16))
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(b), pa.int64()), b.column("rid"), b.column("doc_id"), *both, *(pa.nulls(len(b), t) for t in rest)], names)
    if chunk is not None:
        yield table()


def aligned_forms(forms: DataFrame) -> DataFrame:
    """(fid, la, lb, cuts) of each row of forms (fid, n, sizes): n sizes of A's tokens, then those of B's, with the same sum.

    For each link in order, the positions of its two tokens on their sides, and how many cuts lie at its end or after it. Forms are dealt so that a task has about
    TASK_TOKENS tokens; all windows and groupings that follow keep that partitioning. The meeting by form and end is a grouping by both, which is their full equi-join, as
    an end is one token's on either side. Read from the last end to the first, the running count of cuts is the group and the last token seen is the one that an end lies in.
    """
    total = forms.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    dealt = forms.select("fid", "n", "sizes").repartition(max(shuffle_partitions(forms.sparkSession), -(-total // TASK_TOKENS)), "fid")
    each = dealt.select("fid", "n", F.posexplode("sizes").alias("pos", "size")).withColumn("side", F.col("pos") >= F.col("n"))
    ends = each.withColumn("end", F.sum("size").over(Window.partitionBy("fid", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    met = ends.groupBy("fid", "end").agg(F.max(F.when(~F.col("side"), F.col("pos"))).alias("a"), F.max(F.when(F.col("side"), F.col("pos") - F.col("n"))).alias("b"))
    back = Window.partitionBy("fid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    pieces = met.select("fid", "end", F.sum(cut).over(back).cast("int").alias("cuts"), F.last("a", True).over(back).alias("la"), F.last("b", True).over(back).alias("lb"))
    links = pieces.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("end", "la", "lb", "cuts"))).alias("x"))
    return links.select("fid", "x.la", "x.lb", "x.cuts")


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists: their values one after another, and how many each has."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.ListArray) else pa.concat_arrays(whole.chunks)
    return whole.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(whole).to_numpy(zero_copy_only=False)


def _template(la: list[int], lb: list[int], cuts: list[int], n: int) -> tuple[str, Callable, int]:
    """How a form's groups are written, which of its ids go there, and how many groups there are."""
    text, order, lo = [], [], 0
    for hi in range(1, len(la) + 1):
        if hi == len(la) or cuts[hi] != cuts[lo]:
            a, b = range(la[lo], la[hi - 1] + 1), range(lb[lo] + n, lb[hi - 1] + n + 1)
            text.append(",".join(["%d"] * len(a)) + "|" + ",".join(["%d"] * len(b)))
            order += [*a, *b]
            lo = hi
    return ";".join(text), itemgetter(*order), len(text)


def placed(left: pa.Table, right: pa.Table, narrow: bool) -> Iterator[tuple]:
    """(rid, doc_id, n_a, n_b, n_groups, groups, links) of the texts of a chunk: left has its rows of `coded`, right its forms (k, la, lb, cuts) as aligned."""
    docs, table = (left.filter(f(left.column("low"))) for f in (pa.compute.is_valid, pa.compute.is_null))
    ids, form, form_n, form_m = (_flat(table.column(c))[0].astype(np.int32) for c in ("ids", "form", "form_n", "form_m"))
    ids = ids + NARROW if narrow else ids
    right = right.take(pa.compute.sort_indices(right.column("k")))
    (la, many), (lb, _), (cuts, _) = (_flat(right.column(c)) if right.num_rows else (np.zeros(0, np.int32), np.zeros(0, np.int32)) for c in ("la", "lb", "cuts"))
    kinds: list = [("", None, 0)] * (len(form_n) + 1)  # the last one is of form -1
    n_links, first = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    k = right.column("k").to_numpy()
    n_links[k], first[k] = many, _starts(many)
    xs = [x.tolist() for x in (la, lb, cuts)]
    for i, lo, c in zip(k.tolist(), first[k].tolist(), many.tolist(), strict=True):
        kinds[i] = _template(*(x[lo : lo + c] for x in xs), int(form_n[i]))
    del xs
    # Of each stretch its groups as text, how many tokens and groups it has, and its links.
    n, m = (np.append(x, 0).astype(np.int64)[form] for x in (form_n, form_m))
    at, words = _starts(n + m), []
    for lo in range(0, len(form), NEW):
        part = slice(lo, lo + NEW)
        begin, listed = (at[part] - at[lo]).tolist(), ids[at[lo] : at[lo] + (n + m)[part].sum()].tolist()
        words += [t % get(listed[b:e]) if get else "" for (t, get, _), b, e in zip(map(kinds.__getitem__, form[part].tolist()), begin, [*begin[1:], None], strict=True)]
    n_groups, count = np.array([x[2] for x in kinds])[form], n_links[form]
    own, begin = np.repeat(np.arange(len(form), dtype=np.int32), count), _starts(count)
    j = np.arange(len(own)) + (first[form] - begin)[own]
    links = ids[at[own] + la[j]].astype(np.int64) << 32
    links += ids[(at + n)[own] + lb[j]]
    del own, j, kinds
    (low, sizes), (high, _) = (_flat(docs.column(c)) for c in ("low", "high"))
    units = (high.astype(np.int32) << 16) + low + np.int32(NARROW)
    hi = 0
    for rid, doc, size in zip(docs.column("rid").to_pylist(), docs.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
        lo, hi = hi, hi + size
        u = units[lo:hi]
        c = count[u]
        at_ = np.arange(c.sum()) + np.repeat(begin[u] - _starts(c), c)
        yield rid, doc, int(n[u].sum()), int(m[u].sum()), int(n_groups[u].sum()), ";".join(map(words.__getitem__, u.tolist())), links[at_]


def _over_chunks(docs: DataFrame, pair: Pair, made: tuple, put: Callable[[Iterator[tuple]], list[pa.Array]], schema: str) -> tuple[DataFrame, list[DataFrame]]:
    """put() of the rows of placed(), chunk by chunk, as rows of the schema; and the stored tables that these read."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    narrow, names = pair.narrow, [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core; threads would each hold memory of their own
        yield from coded(Pair(*made), batches)

    def put_all(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(put(placed(left, right, narrow)), names)

    texts = bucketed(base.mapInArrow(run, _coded_schema(narrow)), "chunk")
    tables = texts.where("low IS NULL").select("chunk", F.posexplode(F.arrays_zip("form_n", "sizes")).alias("k", "x")).select("chunk", "k", F.col("x.form_n").alias("n"), "x.sizes")
    forms = stored(tables.groupBy("n", "sizes").agg(F.collect_list(F.struct("chunk", "k")).alias("places")).select(F.monotonically_increasing_id().alias("fid"), "n", "sizes", "places"))
    right = forms.select("fid", "places").join(aligned_forms(forms), "fid").select(F.inline("places"), "la", "lb", "cuts")
    left = texts.drop("sizes")
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(put_all, schema), [texts, forms]


def _columns(rows: Iterator[tuple], n: int) -> list[list]:
    return [list(x) for x in zip(*rows, strict=True)] or [[] for _ in range(n)]


def aligned(docs: DataFrame, folder: str | None = FOLDER, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(rid, doc_id, n_a, n_b, n_groups, groups, links) of each row of docs (doc_id, text).

    groups: `a1,a2|b1;a3|b2,b3`, the ids of A and B of each group in order. links: an array with a pair of ids for each time that they overlap in bytes, as one
    number each (`link`).
    Texts null, empty or not the same after a tokenizer have no tokens, '' and an empty array. Repeated rows are documents of their own; a null doc_id is kept; other columns are not
    read; an empty table gives none. A document's groups and links are one row's, as its text is.
    """

    def put(rows: Iterator[tuple]) -> list[pa.Array]:
        *plain, links = _columns(rows, 7)
        return [*(pa.array(x, t) for x, t in zip(plain, [*[pa.int64()] * 5, pa.string()], strict=True)), _lists(links, pa.int64())]

    made = (byte_bpe, piece_bpe, folder)
    return _over_chunks(docs, Pair(*made), made, put, "rid long, doc_id long, n_a long, n_b long, n_groups long, groups string, links array<long>")[0]


def digested(rows: Iterator[tuple]) -> list[pa.Array]:
    """The columns of digest() that a document gives by itself, and its distinct links with how often it has each, from rows of `placed`."""

    def one(rid, doc, n_a, n_b, n_groups, groups, links):
        link, n = np.unique(links, return_counts=True)
        return rid, doc, n_a, n_b, n_groups, len(links), hashlib.sha256(groups.encode()).hexdigest() if n_a else "", link, n

    *plain, sha, link, n = _columns((one(*r) for r in rows), 9)
    each = pa.StructArray.from_arrays([_lists(link, pa.int64()).values, _lists(n, pa.int32()).values], ["link", "n"])
    return [*(pa.array(x, pa.int64()) for x in plain), pa.array(sha, pa.string()), pa.ListArray.from_arrays(_lists(link, pa.int64()).offsets, each)]


def pair_counts(rows: DataFrame) -> DataFrame:
    """(link, documents, best) from rows (links): how many rows have the pair of ids linked, and whether no other b has more rows for a. Pairs are counted before the shuffle."""
    counts = rows.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("documents"))
    counts = counts.withColumn("a", F.shiftright("link", 32))
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))
    return counts.join(highest, "a").select("link", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def digest(docs: DataFrame, folder: str | None = FOLDER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of documents.

    A document's distinct id pairs are stored with how often it links them. Frequent pairs, at most HOT, are broadcast with their counts; the others are shuffled to
    theirs, a row for a document's pair, of none more than one in HOT of all such rows.
    """
    made = (BYTE_BPE, PIECE_BPE, folder)
    found, used = _over_chunks(docs, Pair(*made), made, digested, "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<link:long,n:int>>")
    rows = stored(found)
    for x in used:
        forget(x)
    counts = stored(pair_counts(rows.select(F.col("pairs.link").alias("links"))))
    total = counts.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    often = F.col("documents") * HOT > total
    hot, rest = counts.where(often).select("link", F.col("documents").alias("hd"), F.col("best").alias("hb")), counts.where(~often)
    near = rows.select("rid", F.inline("pairs")).join(F.broadcast(hot), "link", "left")

    def sums(df: DataFrame) -> DataFrame:
        return df.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("documents")).alias("count_sum"))

    known = sums(near.where("hd IS NOT NULL").select("rid", "n", F.col("hd").alias("documents"), F.col("hb").alias("best")))
    others = sums(near.where("hd IS NULL").select("rid", "link", "n").join(rest, "link"))
    each = known.unionByName(others).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs").join(each, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
