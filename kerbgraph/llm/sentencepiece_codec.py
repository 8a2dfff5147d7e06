"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, blocks, mix

SPACE = "▁"
MARK = SPACE.encode()
#: Bytes of the UTF-8 character that a byte begins.
_WIDTH = np.array([1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.int32)
#: Bytes of text that are solved at once (or one text): about fifty times as much memory is used.
BLOCK_BYTES = 1 << 20
#: What an unknown character costs below the lowest score.
UNKNOWN_PENALTY = 10.0
#: Scores of this and less mark pieces that are never to be used.
NEVER = -1e8
#: Bytes of a part beyond which it is solved by itself, and of a stretch of it whose pieces are looked up at once.
LONG, STRETCH = 1 << 11, 1 << 16


@dataclass
class Trie:
    """A double-array trie over bytes: from state s, byte b leads to base[s] + b if check[there] is s. value[s]: piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    depth: int

    @classmethod
    def build(cls, words: dict[bytes, int]) -> Trie:
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for word, number in words.items():
            at = 0
            for b in word:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ids.append(-1)
                at = children[at][b]
            ids[at] = number
        size = 2 * len(children) + 1024
        base, check, value = (np.full(size, x, np.int32) for x in (0, -1, -1))
        free = np.ones(size, bool)
        free[0] = False
        place, low, queue = {0: 0}, 1, [0]
        value[0] = ids[0]
        for node in queue:
            s, kids = place[node], children[node]
            if not kids:
                continue
            marks = np.array(sorted(kids))
            while not free[low]:
                low += 1
            at = max(low - int(marks[0]), 1)
            if len(marks) == 1 and free[at + marks[0]]:
                offset = at
            else:
                offset = -1
                while offset < 0:
                    if at + 4096 + 256 > len(free):
                        grow = len(free)
                        base, check, value = (np.concatenate([x, np.full(grow, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                        free = np.concatenate([free, np.ones(grow, bool)])
                    ok = free[at + marks[0] : at + marks[0] + 4096].copy()
                    for m in marks[1:]:
                        ok &= free[at + m : at + m + 4096]
                    hit = int(ok.argmax())
                    offset, at = (at + hit, at) if ok[hit] else (-1, at + 4096)
            base[s] = offset
            for b, child in kids.items():
                t = offset + b
                free[t], check[t], value[t], place[child] = False, s, ids[child], t
                queue.append(child)
        end = int(np.flatnonzero(~free).max()) + 257
        return cls(np.resize(base, end), np.append(check[: end - 1], -1), np.append(value[: end - 1], -1), max(map(len, words), default=0))


def log_scores(scores: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces. A model of merges holds the number of the merge, less than 0, in place of a score: such ranks
    become the logarithm of 1 / (rank + 1), which is how often the piece of a rank is used by Zipf's law, in parts of their sum. Scores
    that are no such whole numbers are log probabilities already and stay."""
    ranks = -scores[usable]
    if not len(ranks) or (ranks < 0).any() or (ranks != np.round(ranks)).any() or ranks.max() < 1:
        return scores
    out = scores.copy()
    out[usable] = -np.log(ranks + 1) - np.log(np.sum(1 / (ranks + 1)))
    return out


@dataclass
class Codec:
    """Pieces of a model, ready for arrays of texts."""

    trie: Trie
    scores: np.ndarray
    unknown: float
    byte_ids: np.ndarray
    unknown_id: int
    pairs: np.ndarray
    cut_before_mark: bool
    piece_bytes: np.ndarray
    piece_first: np.ndarray

    @classmethod
    def load(cls, model_file: str) -> Codec:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        rows = [(model.id_to_piece(i), model.get_score(i), model.is_byte(i), model.is_control(i), model.is_unknown(i)) for i in range(n)]
        return cls.of(rows)

    @classmethod
    def of(cls, rows: list[tuple[str, float, bool, bool, bool]]) -> Codec:
        """From (piece, score, is a byte, is control, is unknown) in order of ids."""
        words: dict[bytes, int] = {}
        byte_ids, unknown_id, out = np.full(256, -1, np.int64), 0, []
        for i, (piece, _, is_byte, control, unknown) in enumerate(rows):
            raw = piece.encode()
            if is_byte:
                byte_ids[int(piece[3:-1], 16)] = i
                out.append(bytes([int(piece[3:-1], 16)]))
            elif control or unknown:
                unknown_id = i if unknown else unknown_id
                out.append(b" \xe2\x81\x87 " if unknown else b"")
            else:
                if rows[i][1] > NEVER or piece == SPACE:
                    words.setdefault(raw, i)
                out.append(raw.replace(MARK, b" "))
        usable = np.zeros(len(rows), bool)
        usable[list(words.values())] = True
        scores = np.array([r[1] for r in rows], np.float64)
        if (mark := words.get(MARK)) is not None and scores[mark] <= NEVER:
            # without it a space could only be bytes
            scores[mark] = min((scores[i] for i in words.values() if scores[i] > NEVER), default=0.0)
        scores = log_scores(scores, usable)
        lowest = min((scores[i] for i in words.values()), default=0.0)
        pairs = np.zeros((256, 256), bool)
        for raw in words:
            b = np.frombuffer(raw, np.uint8)
            pairs[b[:-1], b[1:]] = True
        inner = any(SPACE in piece.decode().lstrip(SPACE) for piece in words)
        first = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        return cls(Trie.build(words), scores, lowest - UNKNOWN_PENALTY, byte_ids, unknown_id, pairs, not inner, np.frombuffer(b"".join(out), np.uint8), first)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and first[r] for text r. Empty and null texts have none.

        A text gets a mark before it, and its spaces become marks. It is cut where no piece can lie across, which leaves the
        best path unchanged; equal parts are solved once. Of equal paths the one with the longer earlier piece wins.
        """
        n = len(texts)
        texts = texts.cast(pa.string()).fill_null("")
        some = pc.greater(pc.binary_length(texts), 0)
        marked = pc.binary_join_element_wise(pc.if_else(some, SPACE, ""), pc.replace_substring(texts, " ", SPACE), "")
        _, offsets, data = pa.concat_arrays([marked.combine_chunks() if isinstance(marked, pa.ChunkedArray) else marked]).buffers()
        offsets = np.frombuffer(offsets, np.int32)[: n + 1].astype(np.int64)
        flat = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        cut = np.zeros(len(flat), bool)
        cut[1:] = ~self.pairs[flat[:-1], flat[1:]] & ((flat[1:] & 0xC0) != 0x80)
        if self.cut_before_mark:
            mark = np.zeros(len(flat), bool)
            mark[:-2] = (flat[:-2] == MARK[0]) & (flat[1:-1] == MARK[1]) & (flat[2:] == MARK[2])
            cut[3:] |= mark[3:] & ~mark[:-3]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(flat))
        key = _span_hash(flat, start, end - start)
        _, at, of = np.unique(key, return_index=True, return_inverse=True)
        ids, first = self._solve_all(flat, start[at], end[at])
        count = np.diff(first)[of]
        into = np.concatenate([[0], np.cumsum(count)])
        out = ids[np.arange(into[-1]) + np.repeat(first[:-1][of] - into[:-1], count)]
        return out, into[np.searchsorted(start, offsets)]

    def _solve_all(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every part [start, end) in a row, and first[i] for part i. Short parts are solved together, long ones one by one."""
        long = np.flatnonzero(end - start > LONG)
        if not len(long):
            return self._solve(flat, start, end)
        short = np.flatnonzero(end - start <= LONG)
        ids, first = self._solve(flat, start[short], end[short]) if len(short) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        apart = {int(i): self._solve_long(flat[start[i] : end[i]]) for i in long}
        count = np.zeros(len(start), np.int64)
        count[short] = np.diff(first)
        count[long] = [len(apart[int(i)]) for i in long]
        into = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(into[-1], np.int32)
        out[np.arange(first[-1]) + np.repeat(into[short] - first[:-1], np.diff(first))] = ids
        for i, x in apart.items():
            out[into[i] : into[i] + len(x)] = x
        return out, into

    def _pieces(self, char: np.ndarray, begins: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, bytes, piece) of every piece at the places `begins`, where `left` bytes are left; -1 for a character that is no piece."""
        width = _WIDTH[char[begins]]
        lead = self.trie.base[0] + char[begins]
        state = np.where(self.trie.check[lead] == 0, lead, 0)
        single = np.zeros(len(begins), bool)
        found, walk, which = [], begins, np.arange(len(begins), dtype=np.int32)
        for d in range(self.trie.depth):
            if d:
                ok = left[which] > d
                walk, state, which = walk[ok], state[ok], which[ok]
                there = self.trie.base[state] + char[walk + d]
                ok = self.trie.check[there] == state
            else:
                there, ok = state, state > 0
            walk, state, which = walk[ok], there[ok], which[ok]
            if not len(walk):
                break
            value = self.trie.value[state]
            hit = value >= 0
            found.append((walk[hit], np.full(np.count_nonzero(hit), d + 1, np.int32), value[hit]))
            if d < 4:
                single[which[hit & (width[which] == d + 1)]] = True
        lone = begins[~single]
        found.append((lone, width[~single], np.full(len(lone), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _solve_long(self, part: np.ndarray) -> np.ndarray:
        """The ids of one long part, stretch by stretch: pieces are looked up for a stretch at once, then tried place by place."""
        n = len(part)
        begins = np.flatnonzero((part & 0xC0) != 0x80).astype(np.int32)
        best, back, piece = [float("-inf")] * (n + 1), np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
        best[0] = 0.0
        for lo in range(0, len(begins), STRETCH):
            some = begins[lo : lo + STRETCH]
            walk, size, value = self._pieces(part, some, n - some)
            order = np.lexsort((size, walk))
            walk, size, value = walk[order], size[order], value[order]
            gain = np.where(value >= 0, self.scores[value], self.unknown)
            for at, to, what, plus in zip(walk.tolist(), (walk + size).tolist(), value.tolist(), gain.tolist(), strict=True):
                score = best[at] + plus
                if score > best[to]:
                    best[to], back[to], piece[to] = score, at, what
        out, at = [], n
        while at > 0:
            if piece[at] >= 0 or (self.byte_ids < 0).any():
                out.append([piece[at] if piece[at] >= 0 else self.unknown_id])
            else:
                out.append(self.byte_ids[part[back[at] : at]].tolist())
            at = int(back[at])
        return np.array([i for ids in reversed(out) for i in ids], np.int32)

    def _solve(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi of every part [start, end) at once: first all pieces at all places, then position by position."""
        length = (end - start).astype(np.int32)
        cell = np.concatenate([[0], np.cumsum(length + 1)]).astype(np.int32)
        owner = np.repeat(np.arange(len(start), dtype=np.int32), length)
        local = (np.cumsum(length) - length).astype(np.int32)
        place = np.arange(len(owner), dtype=np.int32) - local[owner]
        char = flat[np.arange(len(owner)) + np.repeat(start - local, length)]
        left = length[owner] - place
        begins = np.flatnonzero((char & 0xC0) != 0x80).astype(np.int32)
        walk, size, value = self._pieces(char, begins, left[begins])
        step = place[walk]
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
        walk, size, value, step = walk[order], size[order], value[order], step[order]
        source = cell[owner[walk]] + step
        target = source + size
        gain = np.where(value >= 0, self.scores[value], self.unknown)
        best = np.full(cell[-1], -np.inf)
        best[cell[:-1]] = 0.0
        back, piece = np.full(cell[-1], -1, np.int32), np.full(cell[-1], -1, np.int32)
        edges = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            s, t = source[lo:hi], target[lo:hi]
            score = best[s] + gain[lo:hi]
            better = score > best[t]
            t = t[better]
            best[t], back[t], piece[t] = score[better], s[better], value[lo:hi][better]
        parts, at, live, pieces = [], cell[1:] - 1, np.arange(len(start), dtype=np.int32), np.zeros(len(start), np.int64)
        while len(live):
            parts.append((live, back[at], at - back[at], piece[at]))
            pieces[live] += 1
            at = back[at]
            go = at > cell[live]
            at, live = at[go], live[go]
        last = np.cumsum(pieces) - 1
        spot = np.concatenate([last[x[0]] - k for k, x in enumerate(parts)])
        live, source, size, value = (_scattered(np.concatenate(x), spot) for x in zip(*parts, strict=True))
        fallback = (value < 0) & bool((self.byte_ids >= 0).all())
        n = np.where(fallback, size, 1)
        out = np.repeat(np.where(value < 0, self.unknown_id, value), n)
        into = np.cumsum(n) - n
        byte = np.repeat(fallback, n)
        raw = np.repeat(start[live] + (source - cell[live]), n) + np.arange(len(out)) - np.repeat(into, n)
        out[byte] = self.byte_ids[flat[raw[byte]]]
        counts = np.bincount(live, weights=n, minlength=len(start)).astype(np.int64)
        return out.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The texts of rows of ids: pieces joined, marks as spaces, without the mark before the text. Bytes that are no UTF-8
        become U+FFFD."""
        ids = ids.astype(np.int64)
        size = np.diff(self.piece_first)[ids]
        into = np.concatenate([[0], np.cumsum(size)])
        raw = self.piece_bytes[np.arange(into[-1]) + np.repeat(self.piece_first[:-1][ids] - into[:-1], size)]
        edge = into[first]
        lead = np.zeros(len(raw), bool)
        filled = edge[:-1][np.diff(edge) > 0]
        lead[filled[raw[filled] == 0x20]] = True
        before = np.concatenate([[0], np.cumsum(lead)])
        edge, raw = edge - before[edge], raw[~lead]
        made = pa.Array.from_buffers(pa.string(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
        try:
            made.validate(full=True)
        except pa.ArrowInvalid:
            data = raw.tobytes()
            made = pa.array([data[a:b].decode(errors="replace") for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.string())
        return made


def _scattered(values: np.ndarray, spot: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[spot] = values
    return out


def _span_hash(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    eight = np.lib.stride_tricks.as_strided(np.concatenate([flat, np.zeros(8, np.uint8)]), (len(flat), 8), (1, 1))
    out, live, at = mix(length.astype(np.uint64)), np.arange(len(start)), start
    left = length
    while len(live):
        word = np.ascontiguousarray(eight[at]).view(np.uint64)[:, 0]
        rest = np.minimum(left, 8).astype(np.uint64)
        word = word << (U(8) * (U(8) - rest))
        out[live] = (out[live] * U(0x9E3779B97F4A7C15)) ^ mix(word + U(0x632BE59BD9B4E019))
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    return mix(out)


def encode(df: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None, decoded: bool = True) -> DataFrame:
    """The columns in `keep` (default: all) with `ids` (array of int, null for a null text, empty for an empty one) and, if
    asked for, `decoded`, the text made from the ids again. Rows are independent; texts are read whole. Columns of these names
    are replaced."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "decoded")]
    codec = df.sparkSession.sparkContext.broadcast(Codec.load(model_file))
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "ids array<int>", *(["decoded string"] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__text")
            for lo, hi in blocks(column, BLOCK_BYTES):
                texts = column.slice(lo, hi - lo)
                ids, first = codec.value.encode(texts)
                null = pa.array(texts.is_null())
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=null)
                more = [pc.if_else(null, pa.scalar(None, pa.string()), codec.value.decode(ids, first))] if decoded else []
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in keep), lists, *more], [*keep, "ids", *(["decoded"] if decoded else [])])

    return df.select(*[f"`{k}`" for k in keep], F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of its ids; null for null ids."""
    keep = [c for c in df.columns if c != out]
    codec = df.sparkSession.sparkContext.broadcast(Codec.load(model_file))
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            size = pc.list_value_length(lists).fill_null(0).to_numpy()
            texts = codec.value.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)], [*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


def round_trip(documents: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (of the comma-joined ids), round_trip of every row.

    round_trip: decoding gives the text back. It can only be false for texts that hold the mark U+2581 itself. Null and empty
    texts have no tokens and come back. Repeated rows get equal results.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    is_byte = [i for i in range(model.get_piece_size()) if model.is_byte(i)]
    known = set(is_byte)
    # from the least to the largest id of a byte, whether each is one
    flags = F.array(*[F.lit(i in known) for i in range(min(is_byte, default=0), max(is_byte, default=0) + 1)])
    df = encode(documents.select("doc_id", "text"), model_file)
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return df.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.size(F.filter(ids, lambda x: F.coalesce(F.get(flags, x - min(is_byte, default=0)), F.lit(False)))).cast("long").alias("n_byte_tokens"),
        F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
    )
