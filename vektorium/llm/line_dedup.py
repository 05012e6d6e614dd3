"""Op 4: line dedup by an exact set-similarity join.

A line's tokens are its distinct words. A line goes if a line before it (by doc_id, then place
in the text) has Jaccard similarity ``threshold`` or more with it; whether that one goes too
does not matter. Blank lines have no tokens and stay.

1. Global line frequencies of all words order each line's tokens, rarest first.
2. Prefix filter: similar lines share a word among the first n - ceil(t * n) + 1 of their n
   tokens, so only these are posted, by ranges of the word's hash; words of one line only are
   not posted at all.
3. Posting lists drop pairs by length, by the place of the common word, and by parity bits of
   the token sets (their differing bits bound the symmetric difference from below): 64 bits,
   128 for lines of more than ``WIDE[0]`` words and 256 for more than ``WIDE[1]``. A list of more
   than two ``BLOCK`` different lines is cut into blocks, and each pair of blocks is a task's work of its own.
4. Equal lines (64-bit sums of their word hashes) are collapsed, inside a pack and again inside posting lists. From
   each list a line sends on its ``NEAREST`` candidates by parity bits, so rows grow with lines
   and not with pairs. Candidates are verified on the whole token sets: the pack of the earlier
   line sends the sets that a pack asks for, each once.
5. Lines that had more candidates than they sent on, of which none was verified (few), go
   through a second, complete round: the lists that had more are kept by the first one, get the token
   sets of the lines that are candidates there, and verify all of them, so that no pairs travel.

Words are compared by 40-bit hashes within pairs of lines, equal lines by 64-bit sums of whole hashes. Defined cases: null and empty texts
have one empty line and stay; equal lines of one text count, the first stays; rows with the same
doc_id are ordered by where they lie in the table; bytes that are no UTF-8 count as U+FFFD; an empty table gives no rows; further columns
pass through ``dedup`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .kernels import SPACE, column_bytes, distinct, lookup, mix, run_hashes, runs, squeeze, unsqueeze
from .packs import ASKED, BITS, PACK_BYTES, Shape, answer, ask, asked, cuts_of, each_pack, make_packs, seal, shape_for, told, unseal
from .shared import cut, table

THRESHOLD = 0.8
_TOKEN = 40
_LINE = np.zeros(256, bool)
_LINE[10] = True
_MOST_LINES = 1 << (64 - _TOKEN)  # of which a line's number and a word fit into 64 bits
# of each posting; v1 is there for lines of more than WIDE[0] words, w2 and w3 for more than WIDE[1]
_COLS = [("tok", np.uint64), ("ord", np.uint32), ("doc", np.int64), ("len", np.uint32), ("pos", np.uint32), ("parity", np.uint64), ("v1", np.uint64), ("w2", np.uint64), ("w3", np.uint64), ("sig", np.uint64), ("flag", np.uint8)]
_POSTED = "bucket long, part long, pack long, n long, packs binary, " + ", ".join(f"{c} binary" for c, _ in _COLS)
_POSTED_ARROW = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("pack", pa.int64()), ("n", pa.int64()), ("packs", pa.binary())] + [(c, pa.binary()) for c, _ in _COLS])
_FOUND = "pack long, ord long, with_pack long, with_ord long"
_FOUND_ARROW = pa.schema([("pack", pa.int64()), ("ord", pa.int64()), ("with_pack", pa.int64()), ("with_ord", pa.int64())])
_HELD = _FOUND + ", key long, low long, high long, held binary"
_HELD_ARROW = pa.schema([*_FOUND_ARROW, ("key", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("held", pa.binary())])
_SETS = "pack long, from_pack long, ords binary, lens binary, toks binary"
_SETS_ARROW = pa.schema([("pack", pa.int64()), ("from_pack", pa.int64()), ("ords", pa.binary()), ("lens", pa.binary()), ("toks", pa.binary())])
NEAREST = 4
BLOCK = 1 << 12
WIDE = (80, 180)
_WIDER = {"v1": WIDE[0], "w2": WIDE[1], "w3": WIDE[1]}


def _sorted_pairs(line: np.ndarray, x: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, x) in order, x below 2**40; one sort of 64-bit numbers, or two keys where there are very many lines."""
    if total <= _MOST_LINES:
        both = np.sort(line.astype(np.uint64) << np.uint64(_TOKEN) | x.astype(np.uint64))
        return (both >> np.uint64(_TOKEN)).astype(np.int64), both & np.uint64((1 << _TOKEN) - 1)
    order = np.lexsort((x, line))
    return line[order], x[order].astype(np.uint64)


class _Lines:
    """Lines of one pack and their token sets; column k of the packed rows is the text, column 0 the id."""

    def __init__(self, t: pa.Table, k: int, tokens: bool = True):
        data, offs = column_bytes(t[f"c{k}"])
        breaks = np.flatnonzero(data == 10)
        # a line starts at each row and after each newline; newline characters belong to no line
        self.data, self.offs = data, offs
        rows = np.searchsorted(offs, breaks, "right") - 1
        per_row = np.bincount(rows, minlength=t.num_rows) + 1 if t.num_rows else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(per_row)])
        total = int(self.first[-1])
        self.starts, self.ends = np.zeros(total, np.int64), np.zeros(total, np.int64)
        head = np.zeros(total, bool)
        head[self.first[:-1]] = True
        self.starts[head], self.starts[~head] = offs[:-1], breaks + 1
        tail = np.zeros(total, bool)
        tail[self.first[1:] - 1] = True
        self.ends[tail], self.ends[~tail] = offs[1:], breaks
        self.row = np.repeat(np.arange(t.num_rows), per_row)
        if tokens:
            starts, ends, _ = runs(data, offs, SPACE)
            h = run_hashes(data, starts, ends)
            words = np.diff(np.append(np.searchsorted(starts, self.starts), len(starts)))
            line = np.repeat(np.arange(total), words)
            self._words = h, words
            self.line, self.tok = _sorted_pairs(line, h >> np.uint64(64 - _TOKEN), total)
            keep = np.ones(len(self.tok), bool)
            keep[1:] = (self.tok[1:] != self.tok[:-1]) | (self.line[1:] != self.line[:-1])
            self.line, self.tok = self.line[keep], self.tok[keep]
            self.len = np.bincount(self.line, minlength=total)
            self.at = np.concatenate([[0], np.cumsum(self.len)])


    def sums(self) -> np.ndarray:
        """Of each line the sum of its words' hashes, repeats included: equal lines have equal sums."""
        h, words = self._words
        out = np.zeros(len(self.len), np.uint64)
        if len(h):
            some = np.flatnonzero(words)
            out[some] = np.add.reduceat(mix(h + np.uint64(1)), (np.cumsum(words) - words)[some])
        return out


def _need(a, b, threshold: float):
    """Smallest overlap of sets of sizes a and b with Jaccard similarity of the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def _identity(lines: _Lines) -> dict[str, np.ndarray]:
    """Parities of each token set, and the 64-bit sum of the line's word hashes as a signature. Of 256 parity bits w0 to w3, v0 and v1 are the 128 got by
    folding once and ``parity`` the 64 got by folding twice; parity, v1, w2 and w3 hold all of them."""
    some = np.flatnonzero(lines.len)
    out = {c: np.zeros(len(lines.len), np.uint64) for c in ("parity", "v1", "w2", "w3")} | {"sig": lines.sums()}
    if len(some):
        h = mix(lines.tok.copy())
        bit, word = np.uint64(1) << (h & np.uint64(63)), h >> np.uint64(6) & np.uint64(3)
        for c, ok in (("parity", None), ("v1", word & np.uint64(1)), ("w2", word == 2), ("w3", word == 3)):
            out[c][some] = np.bitwise_xor.reduceat(bit if ok is None else bit * ok.astype(np.uint64), lines.at[some])
    return out


def _apart(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Differing parity bits of the pairs i, j at the widest width that both have; least: the smaller length."""
    f = c["parity"][i] ^ c["parity"][j]
    out = np.bitwise_count(f).astype(np.int64)
    for k, wide in enumerate(WIDE):
        at = np.flatnonzero(least > wide)
        if len(at):
            a, b = i[at], j[at]
            v1 = c["v1"][a] ^ c["v1"][b]
            words = [f[at] ^ v1, v1]
            if k:
                w2, w3 = c["w2"][a] ^ c["w2"][b], c["w3"][a] ^ c["w3"][b]
                words = [words[0] ^ w2, v1 ^ w3, w2, w3]
            out[at] = sum(np.bitwise_count(w).astype(np.int64) for w in words)
    return out


def _postings(pack: int, lines: _Lines, ids: np.ndarray, total: np.ndarray, u: np.ndarray, shape: Shape, threshold: float) -> pa.Table:
    """Rows of _POSTED; flag marks a line's first posting."""
    own = _identity(lines)
    sig = own["sig"]
    some = np.flatnonzero(lines.len)
    # the earliest of equal lines stands for the others of this pack
    order = np.lexsort((some, ids[lines.row[some]], sig[some], lines.len[some]))
    s = some[order]
    new = np.ones(len(s), bool)
    new[1:] = (lines.len[s][1:] != lines.len[s][:-1]) | (sig[s][1:] != sig[s][:-1])
    stands = np.zeros(len(lines.len), bool)
    stands[s[new]] = True
    # rarest first; words of 65,535 lines or more are ordered by their hash alone
    by_rank = np.argsort(np.minimum(total, (1 << 16) - 1).astype(np.uint16), kind="stable")
    rank = np.empty(len(u), np.int64)
    rank[by_rank] = np.arange(len(u))
    line, by_rarity = _sorted_pairs(lines.line, rank[lookup(u, lines.tok, _TOKEN)], len(lines.len))
    word = by_rank[by_rarity.astype(np.int64)]
    pos = np.arange(len(line)) - lines.at[line]
    n = lines.len[line]
    send = stands[line] & (pos < n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1) & (total[word] > 1)
    k = np.flatnonzero(send)
    first = np.ones(len(k), bool)
    first[1:] = line[k][1:] != line[k][:-1]
    out = {"tok": u[word[k]], "ord": line[k].astype(np.uint32), "doc": ids[lines.row[line[k]]], "len": n[k].astype(np.uint32), "pos": pos[k].astype(np.uint32), "flag": first.astype(np.uint8)} | {c: v[line[k]] for c, v in own.items()}
    order = np.argsort(out["tok"], kind="stable")
    out = {c: v[order] for c, v in out.items()}
    rows = _posted(out, shape, pack, None)
    # copies inside the pack travel as they are
    rows.append({"bucket": -1 - pack, "part": -1, "pack": pack, "n": 0, "ord": squeeze(s[~new].astype(np.uint32))})
    return pa.Table.from_pylist(rows, schema=_POSTED_ARROW)


def _posted(c: dict[str, np.ndarray], shape: Shape, sender: int, packs: np.ndarray | None) -> list[dict]:
    """Rows of _POSTED for postings in order of their words; packs: of each posting, where that is not the sender."""
    rows = []
    for p, lo, hi in cuts_of(shape.parts(c["tok"] << np.uint64(64 - _TOKEN))):
        part = {name: c[name][lo:hi].astype(kind) for name, kind in _COLS}
        for name, wide in _WIDER.items():
            part[name] = part[name][part["len"] > wide]
        whose = None if packs is None else squeeze(packs[lo:hi])
        rows.append({"bucket": shape.bucket(p), "part": p, "pack": sender, "n": hi - lo, "packs": whose} | {name: squeeze(v) for name, v in part.items()})
    return rows


def _opened(t: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Packs and columns of the postings of some rows."""
    packs = np.concatenate([np.full(n, pack) if whose is None else unsqueeze(whose, np.int64) for n, pack, whose in zip(t["n"].to_pylist(), t["pack"].to_pylist(), t["packs"].to_pylist())])
    c = {name: np.concatenate([unsqueeze(x.as_py(), kind) for x in t[name]]) for name, kind in _COLS}
    for name, wide in _WIDER.items():
        full = np.zeros(len(packs), np.uint64)
        full[c["len"] > wide] = c[name]
        c[name] = full
    return packs, c


def _dealt(posted: DataFrame, shape: Shape, bits: int) -> DataFrame:
    """Postings in ranges of about a pack's size: crews of packs send on what they have in a range, as ``answer`` does."""
    if shape.packs <= 1 << bits:
        return posted
    crews = -(-shape.packs >> bits)
    below = Shape(shape.bits + bits, crews, ())

    def run(t: pa.Table) -> pa.Table:
        packs, c = _opened(t)
        order = np.argsort(c["tok"], kind="stable")
        return pa.Table.from_pylist(_posted({k: v[order] for k, v in c.items()}, below, t["crew"][0].as_py(), packs[order]), schema=_POSTED_ARROW)

    sent = posted.where("part >= 0").withColumn("crew", F.pmod(F.xxhash64("pack"), F.lit(crews))).groupBy("part", "crew").applyInArrow(run, _POSTED)
    return _dealt(sent, below, bits).unionByName(posted.where("part < 0"))


def _compared(c: dict[str, np.ndarray], packs: np.ndarray, line: np.ndarray, threshold: float, nearest: int, split: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Candidates of posting lists, each in the order of its lines, as columns of _FOUND; and postings whose line has
    candidates that were not sent. line: numbers of the lines, below 2**32. nearest 0: all candidates of flagged lines.
    split: only pairs of a posting before this place and one from it on."""
    tok, n, pos = c["tok"], c["len"].astype(np.int32), c["pos"].astype(np.int32)
    rest, share = n - pos, threshold / (1 + threshold)
    ends = np.searchsorted(tok, tok, "right")
    best, gap = np.full((len(tok), max(nearest, 1)), -1), np.full((len(tok), max(nearest, 1)), 1 << 30)
    many = np.zeros(len(tok), np.int64)
    pairs = []
    at, step = np.arange(len(tok) if split is None else split), 0
    while True:
        step += 1
        at = at[at + step < ends[at]]
        if not len(at):
            break
        i = at if split is None else at[at + step >= split]
        j = i + step  # the later line
        if not nearest:
            on = c["flag"][j] > 0
            i, j = i[on], j[on]
        both = n[i] + n[j]
        # the common word's places bound the overlap, by the smaller length too
        ok = np.minimum(pos[i], pos[j]) + np.minimum(rest[i], rest[j]) >= share * both - 1e-9
        i, j, both = i[ok], j[ok], both[ok]
        if not len(i):
            continue
        apart = _apart(c, i, j, np.minimum(n[i], n[j]))
        ok = apart <= both - 2 * np.ceil(share * both - 1e-9)
        i, j, apart = i[ok], j[ok], apart[ok]
        if not nearest:
            pairs.append((j, i))
        else:
            many[j] += 1  # a line comes up once in each step
            worst = gap[j].argmax(axis=1)
            better = apart < gap[j, worst]
            best[j[better], worst[better]], gap[j[better], worst[better]] = i[better], apart[better]
    if nearest:
        j, slot = np.nonzero(best >= 0)
        i = best[j, slot]
    else:
        j = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        i = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    _, one = np.unique(line[j] << 32 | line[i], return_index=True)  # a pair may meet at several words
    i, j, ord_ = i[one], j[one], c["ord"].astype(np.int64)
    return [packs[j], ord_[j], packs[i], ord_[i]], np.flatnonzero(many > nearest)


def _more(found: list[np.ndarray], packs: np.ndarray, ords: np.ndarray, key: int, low: int, high: int) -> pa.Table:
    """Rows of _HELD: what was found, and lines (with_pack -2) that have more candidates between blocks low and high of key."""
    none, at = np.full(len(packs), -2), np.concatenate([np.zeros(len(found[0]), bool), np.ones(len(packs), bool)])
    cols = [np.concatenate(x) for x in zip(found, [packs, ords.astype(np.int64), none, none])]
    cols += [pa.array(np.full(len(at), v), mask=~at) for v in (key, low, high)]
    return pa.table([*cols, pa.nulls(len(at), pa.binary())], schema=_HELD_ARROW)


def _kept(key: int, block: int, blocks: int, packs: np.ndarray, c: dict[str, np.ndarray], at: np.ndarray) -> dict:
    """A row of _HELD (with_pack -3) with a block of postings."""
    held = pa.RecordBatch.from_pydict({"pack": packs[at]} | {name: c[name][at] for name, _ in _COLS})
    return {"pack": blocks, "ord": block, "with_pack": -3, "with_ord": -3, "key": key, "held": seal([held], held.schema.names)}


def _candidates(t: pa.Table, threshold: float, nearest: int, block: int) -> pa.Table:
    """One bucket's posting lists: copies (with_pack -1), candidates, lines with more candidates, and postings to be held:
    the blocks of each long list under its word, and the short lists with more candidates as one block under the first
    of their words (with the number of blocks as pack)."""
    if t["bucket"][0].as_py() < 0:
        o = np.concatenate([unsqueeze(x.as_py(), np.uint32) for x in t["ord"]]).astype(np.int64)
        none = np.full(len(o), -1)
        return _more([np.full(len(o), t["pack"][0].as_py()), o, none, none], none[:0], none[:0], 0, 0, 0)
    packs, c = _opened(t)
    # lines in their order (id, pack, place), as numbers; then equal sets under one word
    order = np.lexsort((c["ord"], packs, c["doc"]))
    rank = np.empty(len(order), np.int64)
    same_line = np.zeros(len(order), bool)
    same_line[1:] = (packs[order][1:] == packs[order][:-1]) & (c["ord"][order][1:] == c["ord"][order][:-1])
    rank[order] = np.cumsum(~same_line) - 1
    set_ = mix(mix(c["tok"] << np.uint64(24) ^ c["len"]) ^ c["sig"])
    order = order[np.argsort(set_[order], kind="stable")]
    same = np.zeros(len(order), bool)
    same[1:] = set_[order][1:] == set_[order][:-1]
    copies = order[same]
    copies = copies[c["flag"][copies] > 0]  # equal sets meet at their first posted word; say it there only
    none = np.full(len(copies), -1)
    copies = [packs[copies], c["ord"][copies].astype(np.int64), none, none]
    left = order[~same]
    left = left[np.lexsort((rank[left], c["tok"][left]))]
    size = np.bincount(np.cumsum(np.append(True, c["tok"][left][1:] != c["tok"][left][:-1])) - 1) if len(left) else np.zeros(0, np.int64)
    size = np.repeat(size, size)
    long = left[size > 2 * block]
    left = left[(size > 1) & (size <= 2 * block)]
    short, whose = {name: v[left] for name, v in c.items()}, packs[left]
    found, more = _compared(short, whose, rank[left], threshold, nearest)
    rows, key = [], 0
    if len(more):
        at = np.flatnonzero(np.isin(short["tok"], short["tok"][more]))
        key = int(short["tok"][at[0]])
        rows.append(_kept(key, 0, 1, whose, short, at))
    for word, lo, hi in cuts_of(c["tok"][long].astype(np.int64)):
        cut_ = np.array_split(long[lo:hi], -(-(hi - lo) // block))
        rows += [_kept(word, k, len(cut_), packs, c, at) for k, at in enumerate(cut_)]
    found = [np.concatenate(x) for x in zip(found, copies)]
    return pa.concat_tables([_more(found, whose[more], short["ord"][more], key, 0, 0), pa.Table.from_pylist(rows, schema=_HELD_ARROW)])


def _pair(t: pa.Table, threshold: float, nearest: int, open_: pa.Table | None = None) -> tuple[pa.Table, list, np.ndarray]:
    """Two blocks of one key, or one, through ``_compared``; open_: lines of the second round. Postings and what was found."""
    blocks = [unseal(t["held"][k].as_py()) for k in np.argsort(t["block"].to_numpy()).tolist()]
    both = pa.concat_tables(blocks).combine_chunks()
    c = {name: both[name].to_numpy() for name, _ in _COLS}
    if open_ is not None:
        lines = set(zip(open_["pack"].to_pylist(), open_["ord"].to_pylist()))
        c["flag"] = np.array([x in lines for x in zip(both["pack"].to_pylist(), c["ord"].tolist())], np.uint8)
    packs = both["pack"].to_numpy()
    order = np.lexsort((c["ord"], packs))
    line = np.empty(len(order), np.int64)
    line[order] = np.cumsum(np.append(False, (np.diff(packs[order]) != 0) | (np.diff(c["ord"][order]) != 0))[: len(order)])
    return both, *_compared(c, packs, line, threshold, nearest, blocks[0].num_rows if len(blocks) > 1 else None)


def _blocks(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The held blocks that each of pairs(key, low, high) takes."""
    held = found.where("with_pack = -3").select("key", F.col("ord").alias("block"), "held")
    return pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high")))).join(held, ["key", "block"])


def _first_round(posted: DataFrame, threshold: float, nearest: int) -> DataFrame:
    """Rows of _HELD for all postings, checkpointed."""
    block, seen = BLOCK, Observation()
    found = posted.groupBy("bucket").applyInArrow(lambda t: _candidates(t, threshold, nearest, block), _HELD)
    found = cut(found.observe(seen, F.count(F.when(F.expr("with_pack = -3 AND pack > 1"), 1)).alias("long")).distinct())
    if not seen.get["long"]:
        return found

    def pair(t: pa.Table) -> pa.Table:
        both, out, more = _pair(t, threshold, nearest)
        return _more(out, both["pack"].to_numpy()[more], both["ord"].to_numpy()[more], *(t[x][0].as_py() for x in ("key", "low", "high")))

    long = found.where("with_pack = -3 AND pack > 1").select("key", F.col("ord").alias("high"), F.explode(F.sequence(F.lit(0).cast("long"), "ord")).alias("low"))
    return cut(found.unionByName(_blocks(found, long).groupBy("key", "low", "high").applyInArrow(pair, _HELD)).distinct())


def _sets(t: pa.Table, k: int, ords: np.ndarray) -> _Lines:
    """The token sets of these lines of a pack (in this order)."""
    lines = _Lines(t, k, tokens=False)
    raw = lines.data.tobytes()
    return _Lines(pa.table({f"c{k}": pa.array([raw[a:b] for a, b in zip(lines.starts[ords].tolist(), lines.ends[ords].tolist())], pa.binary())}), k)


def _sent(packs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Rows of _SETS with the token sets of the lines wanted(pack, ord, to), each once for each ``to``, which is their pack."""

    def send(pack, t, w):
        if pack is None or not w.num_rows:
            return _SETS_ARROW.empty_table()
        ords, to, out = w["ord"].to_numpy(), w["to"].to_numpy(), []
        every = distinct(ords)
        own = _sets(t, k, every)
        order = np.argsort(to, kind="stable")
        for p, lo, hi in cuts_of(to[order]):
            mine = distinct(ords[order[lo:hi]])
            at = np.searchsorted(every, mine)
            toks = np.concatenate([own.tok[own.at[x] : own.at[x + 1]] for x in at.tolist()])
            out.append({"pack": p, "from_pack": pack, "ords": squeeze(mine), "lens": squeeze(own.len[at].astype(np.uint32)), "toks": squeeze(toks)})
        return pa.Table.from_pylist(out, schema=_SETS_ARROW)

    return each_pack(packs, send, _SETS, wanted)


def _received(t: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Token sets by pack and line, from rows of _SETS."""
    out = {}
    for r in t.select(["from_pack", "ords", "lens", "toks"]).to_pylist():
        cuts = np.cumsum(unsqueeze(r["lens"], np.uint32).astype(np.int64))[:-1]
        for o, x in zip(unsqueeze(r["ords"], np.int64).tolist(), np.split(unsqueeze(r["toks"], np.uint64), cuts)):
            out[r["from_pack"], o] = x
    return out


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    both = np.sort(np.concatenate([a, b]))
    return (both[1:] == both[:-1]).sum() >= _need(len(a), len(b), threshold)


def _verified(packs: DataFrame, pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(pack, ord) of those of pairs(pack, ord, with_pack, with_ord) whose whole token sets have the similarity."""
    wanted = pairs.select(F.col("with_pack").alias("pack"), F.col("with_ord").alias("ord"), F.col("pack").alias("to")).distinct()

    def verify(pack, t, both):
        pairs = both.filter(pc.is_null(both["from_pack"]))
        none = pa.table({"pack": pa.array([], pa.int64()), "ord": pa.array([], pa.int64())})
        if pack is None or not pairs.num_rows:
            return none
        others = _received(both.filter(pc.is_valid(both["from_pack"])))
        ords = distinct(pairs["ord"].to_numpy())
        own, good = _sets(t, k, ords), set()
        for j, p, o in zip(pairs["ord"].to_pylist(), pairs["with_pack"].to_pylist(), pairs["with_ord"].to_pylist()):
            if j not in good:
                at = int(np.searchsorted(ords, j))
                if _alike(own.tok[own.at[at] : own.at[at + 1]], others[p, o], threshold):
                    good.add(j)
        good = np.array(sorted(good), np.int64)
        return pa.table({"pack": np.full(len(good), pack), "ord": good}) if len(good) else none

    mixed = pairs.select("pack", "ord", "with_pack", "with_ord").unionByName(_sent(packs, wanted, k), allowMissingColumns=True)
    return each_pack(packs, verify, "pack long, ord long", mixed)


def _second_round(packs: DataFrame, found: DataFrame, unsure: DataFrame, k: int, threshold: float) -> DataFrame:
    """(pack, ord) of the lines unsure(pack, ord, key, low, high) that have a similar line before them between these blocks."""
    by = ["key", "low", "high"]
    tasks = cut(unsure.select(*by).distinct().withColumn("task", F.monotonically_increasing_id()))
    open_ = cut(unsure.join(tasks, by).select("task", "pack", "ord"))
    held = cut(_blocks(found, tasks).select("task", "block", "held"))

    def lines(t: pa.Table, o: pa.Table) -> pa.Table:
        a, b, c, d = _pair(t, threshold, 0, o)[1]
        lines = np.unique(np.stack([np.concatenate([a, c]), np.concatenate([b, d])]), axis=1)
        return pa.table({"pack": lines[0], "ord": lines[1], "to": np.full(lines.shape[1], t["task"][0].as_py())})

    def verify(t: pa.Table, both: pa.Table) -> pa.Table:
        found = _pair(t, threshold, 0, both.filter(pc.is_null(both["from_pack"])))[1]
        sets, good = _received(both.filter(pc.is_valid(both["from_pack"]))), set()
        for p, o, with_p, with_o in zip(*(x.tolist() for x in found)):
            if (p, o) not in good and _alike(sets[p, o], sets[with_p, with_o], threshold):
                good.add((p, o))
        good = np.array(sorted(good), np.int64).reshape(-1, 2)
        return pa.table({"pack": good[:, 0], "ord": good[:, 1]})

    wanted = held.groupBy("task").cogroup(open_.groupBy("task")).applyInArrow(lines, "pack long, ord long, to long")
    sets = _sent(packs, wanted, k).withColumnRenamed("pack", "task")
    both = open_.unionByName(sets, allowMissingColumns=True)
    return held.groupBy("task").cogroup(both.groupBy("task")).applyInArrow(verify, "pack long, ord long")


def removed_lines(packs: DataFrame, k: int, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """(pack, ord) of all lines that go; k is the number of the text column in the packs, column 0 has the ids."""
    if not packs.select("pack").head(1):  # where nothing runs, nothing can be observed below
        return packs.sparkSession.createDataFrame([], "pack long, ord long")
    shape = shape_for(packs, bits)

    def count(pack, t, _):
        lines = _Lines(t, k)
        u, c = np.unique(lines.tok, return_counts=True)
        return asked(ask(pack, 0, u << np.uint64(64 - _TOKEN), c, shape))

    totals = cut(answer(each_pack(packs, count, ASKED), shape, bits))

    def post(pack, t, replies):
        lines = _Lines(t, k)
        u = distinct(lines.tok)
        ids = t["c0"].fill_null(-(1 << 62)).to_numpy()
        return _postings(pack, lines, ids, told(replies, 0, u << np.uint64(64 - _TOKEN), shape), u, shape, threshold)

    found = _first_round(_dealt(each_pack(packs, post, _POSTED, totals), shape, bits), threshold, NEAREST)
    sure = found.where("with_pack = -1").select("pack", "ord")
    pairs = found.where("with_pack >= 0").join(sure, ["pack", "ord"], "left_anti")
    first = cut(_verified(packs, pairs, k, threshold))
    gone = sure.unionByName(first)
    unsure = cut(found.where("with_pack = -2").join(gone, ["pack", "ord"], "left_anti").select("pack", "ord", "key", "low", "high"))
    if unsure.head(1):  # the complete round, for lines whose nearest candidates failed
        gone = gone.unionByName(_second_round(packs, found, unsure, k, threshold))
    return gone.distinct()


def _apply(docs: DataFrame, threshold: float, pack_bytes: int, finish, schema: str, k: int) -> DataFrame:
    packs = make_packs(docs, pack_bytes)

    def end(pack, t, gone):
        lines = _Lines(t, k, tokens=False)
        drop = np.zeros(len(lines.starts), bool)
        drop[gone["ord"].to_numpy()] = True
        raw, out = lines.data.tobytes(), []
        removed = np.add.reduceat(drop, lines.first[:-1], dtype=np.int64) if t.num_rows else np.zeros(0, np.int64)
        for r in range(t.num_rows):
            if removed[r]:
                keep = np.flatnonzero(~drop[lines.first[r] : lines.first[r + 1]]) + lines.first[r]
                out.append(b"\n".join([raw[a:b] for a, b in zip(lines.starts[keep].tolist(), lines.ends[keep].tolist())]))
            else:
                out.append(raw[lines.offs[r] : lines.offs[r + 1]])
        return finish(t, out, np.diff(lines.first), removed)

    return each_pack(packs, end, schema, removed_lines(packs, k, threshold))


def dedup(docs: DataFrame, threshold: float = THRESHOLD, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """docs without the lines that go; null texts stay null, further columns pass through."""
    names = docs.columns
    front = ["doc_id", "text", *[c for c in names if c not in ("doc_id", "text")]]

    def finish(t, texts, n, removed):
        was = t["c1"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        t = t.set_column(1, "c1", pa.array([None if w else x.decode(errors="replace") for x, w in zip(texts, was)], pa.string()))
        return t.rename_columns(front)

    schema = docs.select(*front).schema
    return _apply(docs.select(*front), threshold, pack_bytes, finish, schema, 1).select(*names)


def digests(docs: DataFrame, threshold: float = THRESHOLD, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256): lines of each text, those that go, and the digest of what stays."""

    def finish(t, texts, n, removed):
        return pa.table({"doc_id": t["c0"], "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())})

    return _apply(docs.select(F.col("doc_id").cast("long"), "text"), threshold, pack_bytes, finish, "doc_id long, n_lines long, n_removed long, kept_sha256 string", 1)


def query(spark, sf_dir: str) -> DataFrame:
    """op4_line_dedup: every line of all documents, Jaccard similarity 0.8."""
    return digests(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM d),
t AS (SELECT doc_id, n, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM l),
sets AS (SELECT s, min({'d': doc_id, 'n': n}) AS first, row_number() OVER () AS k FROM t WHERE len(s) > 0 GROUP BY s),
words AS (SELECT k, first, len(s) AS size, unnest(s) AS w FROM sets),
ranked AS (SELECT k, first, size, w, row_number() OVER (PARTITION BY k ORDER BY c, w) AS r FROM words JOIN (SELECT w, count(*) AS c FROM words GROUP BY w) USING (w)),
prefix AS (SELECT * FROM ranked WHERE r <= size - ceil(0.8 * size - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.k AS earlier, b.k AS later FROM prefix AS a JOIN prefix AS b ON a.w = b.w AND a.first < b.first AND a.size * 5 >= b.size * 4 AND b.size * 5 >= a.size * 4),
alike AS (SELECT DISTINCT b.k FROM pairs JOIN sets AS a ON a.k = earlier JOIN sets AS b ON b.k = later WHERE len(list_intersect(a.s, b.s)) * 9 >= (len(a.s) + len(b.s)) * 4),
marked AS (SELECT t.doc_id, t.n, t.line, sets.k IS NOT NULL AND (sets.first <> {'d': t.doc_id, 'n': t.n} OR alike.k IS NOT NULL) AS gone FROM t LEFT JOIN sets USING (s) LEFT JOIN alike ON alike.k = sets.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY 1
"""
