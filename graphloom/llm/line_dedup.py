"""Operator 8: line dedup by an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.arrow import slices, text_bytes, tuned
from graphloom.llm.hashing import bytes_set, mix, set_bytes, word_chunks, words
from graphloom.llm.id_filter import maybe_among, maybe_token
from graphloom.llm.signature_tree import similar
from graphloom.llm.sketch import count_sketch, slot
from graphloom.session import Scratch

#: Least similarity in percent, and words that a line must have to be compared at all.
PERCENT, LEAST_WORDS = 80, 5
#: Candidates that a line keeps of each token in the first round; the lines that this leaves open are joined whole after it.
FIRST_ROUND = 16
#: Lines of a token that one task compares; a token that more lines have is dealt into pairs of blocks.
BLOCK = 4096
#: Bytes of a token's hash that are kept with a line, and low bits of a posting's key, which hold the line's size.
TOKEN_BYTES, SIZE_BITS = 5, 30
#: Numbers of a posting (key, doc_id, line and place, two of the bitmap), postings of a bucket, about, and of what a task deals out at once.
POSTING, BUCKET, DEALT = 5, 1 << 15, 1 << 19
#: Slots for the line keys that a task has posted, and keys that it has posted twice, which it posts no third time.
SEEN_BITS, HELD_KEYS = 22, 65_536
#: Rows of a file of a small intermediate table.
FILE_ROWS = 1 << 16


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt out for one file each FILE_ROWS of its about ``rows`` rows: tables of few rows are not written in a file a task."""
    return df.repartition(1 + rows // FILE_ROWS)


def line_offsets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of all lines and the end, the row of each line, its number in the row) of rows of bytes."""
    breaks = np.flatnonzero(raw == 10)
    at = np.concatenate([breaks + 1, offsets[:-1]])
    row = np.concatenate([np.searchsorted(offsets, breaks, side="right") - 1, np.arange(offsets.size - 1)])
    order = np.lexsort((np.arange(at.size), row, at))
    order = order[np.lexsort((at[order], row[order]))]
    at, row = at[order], row[order]
    first = np.searchsorted(row, row)
    return np.append(at, raw.size), row, np.arange(row.size) - first


def need(n_a, n_b, percent: int):
    """The least overlap of two similar sets of these sizes."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def rarity(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """20 bits that grow with a word's count: the order by rarity, in steps of less than one part in 2000."""
    return (counts[slot(hashes)].astype(np.float32).view(np.uint32) >> np.uint32(11)).astype(np.uint64)


def by_rarity(line: np.ndarray, rank: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order by (line, rank, hash): one order of words for the whole corpus."""
    if line.size and int(line[-1]) < 1 << 20:
        key = line.astype(np.uint64) << np.uint64(44) | rank << np.uint64(24) | hashes >> np.uint64(40)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        if (hashes[order[1:]][same] == hashes[order[:-1]][same]).all():
            return order
    return np.lexsort((hashes, rank, line))


def token_bytes(hashes: np.ndarray) -> np.ndarray:
    """The high TOKEN_BYTES bytes of each hash, end to end."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BYTES :])


def bytes_token(raw: np.ndarray) -> np.ndarray:
    """The hashes, their low bytes 0, of what token_bytes() gave."""
    out = np.zeros((raw.size // TOKEN_BYTES, 8), np.uint8)
    out[:, 8 - TOKEN_BYTES :] = raw.reshape(-1, TOKEN_BYTES)
    return out.view("<u8").ravel()


class Posted:
    """The keys that a task has posted more than once, with the place of one posting each, in a table of bounded size."""

    def __init__(self):
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.known = [np.zeros(0, np.int64)] * 4  # key1 in order, key2, doc, line

    def check(self, key1, key2, doc, line) -> np.ndarray:
        """Which of these distinct keys were posted with an earlier place; the others count as posted now."""
        known1, known2, known_doc, known_line = self.known
        at = np.minimum(np.searchsorted(known1, key1), max(known1.size - 1, 0))
        here = (known1[at] == key1) & (known2[at] == key2) if known1.size else np.zeros(key1.size, bool)
        earlier = here.copy()
        earlier[here] = (known_doc[at[here]] < doc[here]) | (known_doc[at[here]] == doc[here]) & (known_line[at[here]] < line[here])
        place = (mix(key1.view(np.uint64)) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
        new = np.flatnonzero(self.seen[place] & ~here)
        self.seen[place] = True
        if new.size:
            if known1.size + new.size > HELD_KEYS:
                self.__init__()
            both = [np.concatenate([x, y[new].astype(np.int64)]) for x, y in zip(self.known, (key1, key2, doc, line))]
            order = np.argsort(both[0], kind="stable")
            self.known = [x[order] for x in both]
        return earlier


def line_rows(docs: DataFrame, counts: np.ndarray, percent: int, least_words: int) -> DataFrame:
    """One row a line of ``least_words`` distinct words or more: its place, size, key, 128-bit bitmap (sig, sig2) and prefix tokens, rarest first.

    A line that repeats an earlier one of the same task has null tokens and bitmaps and a key of its own: a line that very many documents
    have is brought together about twice a task, and its repeats are spread evenly. Equal lines at one place, of rows that occur twice, are one line.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def chunk(raw, offsets, ids, posted):
        at, row, number = line_offsets(raw, offsets)
        hashed, where = words(raw, at)
        size = np.diff(where)
        lines = np.flatnonzero(size >= least_words)
        if not lines.size:
            return None
        place_of = np.full(size.size, -1)
        place_of[lines] = np.arange(lines.size)
        of = np.repeat(place_of, size)
        h, of = hashed[of >= 0], of[of >= 0]
        order = by_rarity(of, rarity(held.value, h), h)
        h, of = h[order], of[order]
        new = np.ones(h.size, bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
        n = np.bincount(of, minlength=lines.size)
        keep = n >= least_words
        h, lines, n = h[keep[of]], lines[keep], n[keep]
        if not lines.size:
            return None
        begin = np.cumsum(n) - n
        place = np.arange(h.size) - np.repeat(begin, n)
        # A set too small for a similar one of another size matches only its equal, which its key finds: it needs no tokens.
        take = np.where(100 * n >= percent * (n + 1), n - -(-percent * n // 100) + 1, 0)
        with np.errstate(over="ignore"):
            key1 = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin).view(np.int64)
            key2 = np.add.reduceat(mix(h ^ np.uint64(0x14057B7EF767814F)), begin).view(np.int64)
        bit, high = np.uint64(1) << (h & np.uint64(63)), (h & np.uint64(64)) > 0
        sig, sig2 = (np.bitwise_or.reduceat(np.where(own, bit, np.uint64(0)), begin).view(np.int64) for own in (~high, high))
        doc, number = ids[row[lines]], number[lines]
        order = np.lexsort((number, doc, key2, key1))
        again, twin = np.zeros(lines.size, bool), np.zeros(lines.size, bool)
        same = (key1[order[1:]] == key1[order[:-1]]) & (key2[order[1:]] == key2[order[:-1]])
        at_first = (doc[order[1:]] == doc[order[:-1]]) & (number[order[1:]] == number[order[:-1]])
        twin[order[1:]] = same & at_first
        # The class's first place, as often as it occurs, is no repeat; all later places are.
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        first_of = np.repeat(order[starts], np.diff(np.append(starts, order.size)))
        again[order] = (doc[order] != doc[first_of]) | (number[order] != number[first_of])
        earlier = posted.check(*(x[order[starts]] for x in (key1, key2, doc, number)))
        again[order[np.repeat(earlier, np.diff(np.append(starts, order.size)))]] = True
        key1[again] = mix(doc[again].astype(np.int64).view(np.uint64) + number[again].astype(np.uint64) * np.uint64(31)).view(np.int64)
        key2[again] = 0
        prefix = (place < np.repeat(take, n)) & ~np.repeat(again, n)
        cut = np.concatenate([[0], np.cumsum(np.where(again, 0, take))]) * TOKEN_BYTES
        valid = pa.py_buffer(np.packbits(~again, bitorder="little"))
        tokens = pa.Array.from_buffers(pa.binary(), lines.size, [valid, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(token_bytes(h[prefix]))])
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "line": pa.array(number, pa.int32()), "n": pa.array(n, pa.int32()), "key1": pa.array(key1), "key2": pa.array(key2), "sig": pa.array(sig, mask=again), "sig2": pa.array(sig2, mask=again), "tokens": tokens}).filter(pa.array(~twin))

    def run(batches):
        posted = Posted()
        for whole in batches:
            for batch in slices(whole):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                raw, offsets = text_bytes(batch)
                at = 0
                while at < len(ids):
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 19), side="right")) - 1)
                    out = chunk(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], ids[at:to], posted)
                    if out is not None:
                        yield out
                    at = to

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, line int, n int, key1 long, key2 long, sig long, sig2 long, tokens binary")


def line_classes(lines: DataFrame) -> DataFrame:
    """doc_id, line, n, sig and tokens of every line; tokens are null for all but the first line of those with equal word sets.

    First lines without tokens match no other class and are left out.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartition(parts, "key1", "key2").sortWithinPartitions("key1", "key2", "doc_id", "line")

    def run(batches):
        last = None
        for batch in batches:
            k1, k2 = batch.column("key1").to_numpy(), batch.column("key2").to_numpy()
            if not k1.size:
                continue
            first = np.ones(k1.size, bool)
            first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            first[0] = last is None or last[:2] != (k1[0], k2[0])
            doc, line = batch.column("doc_id").to_numpy(), batch.column("line").to_numpy()
            twin = np.zeros(k1.size, bool)  # the line before once more, of a row that occurs twice
            twin[1:] = ~first[1:] & (doc[1:] == doc[:-1]) & (line[1:] == line[:-1])
            twin[0] = last == (k1[0], k2[0], doc[0], line[0])
            last = (k1[-1], k2[-1], doc[-1], line[-1])
            tokens = batch.column("tokens")
            first &= tokens.is_valid().to_numpy(zero_copy_only=False)
            alone = first & (pc.binary_length(tokens).fill_null(0).to_numpy(zero_copy_only=False) == 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "line", "n", "sig", "sig2")), pc.if_else(pa.array(first), tokens, pa.scalar(None, tokens.type))], names=["doc_id", "line", "n", "sig", "sig2", "tokens"]).filter(pa.array(~twin & ~alone))

    return dealt.mapInArrow(run, "doc_id long, line int, n int, sig long, sig2 long, tokens binary")


def posting_columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """token, place, n, doc_id, line and sig of every prefix token of a batch of classes."""
    raw, offsets = text_bytes(batch, "tokens")
    size = np.diff(offsets) // TOKEN_BYTES
    begin = offsets[:-1] // TOKEN_BYTES
    out = {c: np.repeat(batch.column(c).to_numpy(), size) for c in ("n", "doc_id", "line", "sig", "sig2")}
    return out | {"token": bytes_token(raw), "place": np.arange(int(size.sum())) - np.repeat(begin, size)}


def block_counts(counts: np.ndarray, noise: int) -> np.ndarray:
    """Into how many blocks the lines of tokens of these counts are dealt."""
    return np.maximum(1, -(-np.maximum(counts.astype(np.int64) - noise, 0) // BLOCK))


def token_blocks(counts: np.ndarray):
    """A function of (tokens, docs, lines): into how many blocks each token's lines are dealt, and the line's own block."""
    noise = int(np.median(counts))

    def blocks(held, col):
        k = block_counts(held[slot(col["token"])], noise)
        return k, (mix(col["doc_id"].view(np.uint64) + col["line"].astype(np.uint64) * np.uint64(31)) % k.astype(np.uint64)).astype(np.int64)

    return blocks


def later_first(doc, line, n, place, sig, sig2, cell, percent: int, most: int):
    """(later, earlier, open) rows of candidate pairs of a run sorted by (cell, n).

    Row i meets row i + d of its cell for d = 1, 2, ... while the sizes allow it, all rows at once. A row whose place leaves too few
    tokens for any row of its size or more starts no pair. A pair passes if the tokens left after its places (positional
    filter) and the bitmaps allow the overlap that it needs. The later row of a pair takes ``most`` candidates; ``open`` rows have had more.
    """
    size, later_of, earlier_of = len(doc), [], []
    met = np.zeros(size, np.int32)
    n = n.astype(np.int64)
    key = cell.astype(np.int64) << 32
    reach = np.searchsorted(key | n, key | 100 * n // percent, side="right") - 1 - np.arange(size)
    # left >= need(n, n') is own >= least', where left is the number of tokens from the place on.
    own, least = (n - place) * (100 + percent) - percent * n, percent * n
    starts = np.flatnonzero((reach > 0) & (own >= least))
    starts = starts[np.argsort(-reach[starts], kind="stable")]
    reach, own_i, least_i, d = -reach[starts], own[starts], least[starts], 1
    while True:
        active = int(np.searchsorted(reach, -d, side="right"))
        if not active:
            break
        j = starts[:active] + d
        fits = np.flatnonzero((own_i[:active] >= least[j]) & (own[j] >= least_i[:active]))
        i, j = starts[fits], j[fits]
        common = need(n[i], n[j], percent)
        fits = n[i] - np.bitwise_count(sig[i] & ~sig[j]) - np.bitwise_count(sig2[i] & ~sig2[j]) >= common
        fits &= n[j] - np.bitwise_count(sig[j] & ~sig[i]) - np.bitwise_count(sig2[j] & ~sig2[i]) >= common
        i, j = i[fits], j[fits]
        i_later = (doc[i] > doc[j]) | (doc[i] == doc[j]) & (line[i] > line[j])
        late, early = np.where(i_later, i, j), np.where(i_later, j, i)
        new = met[late] < most
        later_of.append(late[new])
        earlier_of.append(early[new])
        np.add.at(met, late, 1)
        d += 1
    later = np.concatenate(later_of) if later_of else np.zeros(0, np.int64)
    earlier = np.concatenate(earlier_of) if earlier_of else np.zeros(0, np.int64)
    return later, earlier, np.flatnonzero(met > most)


PAIR = "doc_b long, line_b int, doc_a long, line_a int"


def token_counts(classes: DataFrame) -> np.ndarray:
    return count_sketch(classes.select("tokens"), lambda batch: [bytes_token(text_bytes(batch, "tokens")[0])])


def dealt_postings(posts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """bucket and the packed postings of each bucket that has any of ``posts`` (a row a posting, its key first): a cell is whole in one bucket."""
    own = (mix((posts[:, 0] >> SIZE_BITS).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    own = own[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    at = np.append(starts, own.size) * (8 * POSTING)
    packed = pa.Array.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(posts[order])])
    return pa.RecordBatch.from_pydict({"bucket": pa.array(own[starts].astype(np.int32)), "posts": packed})


def candidates(classes: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """First-round pairs (b later, a earlier) of classes that share a prefix token; a null a marks a b that has had more.

    A token that more than BLOCK classes have in their prefixes is dealt into pairs of blocks. A posting's key is one long, the token's
    high bits and the line's size: sorted by this one number, cells are runs in order of size. Postings move packed by buckets of whole
    cells, a row for all that a task has for a bucket, and the task that gets a bucket sorts it; the number of buckets follows that of postings.
    """
    held, blocks = classes.sparkSession.sparkContext.broadcast(counts), token_blocks(counts)
    low = np.uint64(SIZE_BITS)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    buckets = max(6 * parts, int((counts * block_counts(counts, int(np.median(counts)))).sum()) // BUCKET)

    def post(batches):
        kept, rows = [], 0

        def sent():
            posts = np.concatenate(kept)
            for at in range(0, rows, DEALT):
                yield dealt_postings(posts[at : at + DEALT], buckets)

        for whole in batches:
            for batch in slices(whole, 1 << 14):
                col = posting_columns(batch)
                k, own = blocks(held.value, col)
                at = np.repeat(np.arange(k.size), k)
                other = np.arange(at.size) - np.repeat(np.cumsum(k) - k, k)
                cell = np.minimum(own[at], other) * k[at] + np.maximum(own[at], other)
                token = np.where(cell > 0, mix(col["token"][at] + cell.astype(np.uint64)), col["token"][at])
                key = token >> low << low | col["n"][at].astype(np.uint64)
                place = col["line"][at].astype(np.int64) << 32 | col["place"][at]
                kept.append(np.stack([key.view(np.int64), col["doc_id"][at], place, col["sig"][at], col["sig2"][at]], axis=1))
                rows += at.size
                if rows >= DEALT:
                    yield from sent()
                    kept, rows = [], 0
        if rows:
            yield from sent()

    posts = classes.select("doc_id", "line", "n", "sig", "sig2", "tokens").mapInArrow(post, "bucket int, posts binary")
    dealt = posts.repartition(parts, "bucket").sortWithinPartitions("bucket")

    def run(batches):
        kept: list[pa.Table] = []

        def pairs(table):
            posts = text_bytes(table, "posts")[0].view(np.int64).reshape(-1, POSTING)
            # Lines of one size are in order of doc_id in every cell, so that a group of near lines meets in the same pairs under all its tokens.
            key, doc, at, sig, sig2 = np.ascontiguousarray(posts[np.lexsort((posts[:, 1], posts[:, 0]))].T)
            token, line = key >> SIZE_BITS, (at >> 32).astype(np.int32)
            starts = np.ones(len(key), np.int64)
            starts[1:] = token[1:] != token[:-1]
            b, a, more = later_first(doc, line, key & (1 << SIZE_BITS) - 1, at & 0xFFFFFFFF, sig.view(np.uint64), sig2.view(np.uint64), np.cumsum(starts), percent, FIRST_ROUND)
            none = [None] * more.size
            if b.size or more.size:
                yield pa.RecordBatch.from_pydict({"doc_b": pa.array(np.concatenate([doc[b], doc[more]])), "line_b": pa.array(np.concatenate([line[b], line[more]])), "doc_a": pa.concat_arrays([pa.array(doc[a]), pa.array(none, pa.int64())]), "line_a": pa.concat_arrays([pa.array(line[a]), pa.array(none, pa.int32())])})

        rows = 0
        for whole in batches:
            for batch in slices(whole):
                kept.append(pa.Table.from_batches([batch]))
                rows += int(pc.sum(pc.binary_length(batch.column("posts"))).as_py() or 0) // (8 * POSTING)
                if rows < 1 << 16:
                    continue
                table = pa.concat_tables(kept)
                bucket = table.column("bucket").to_numpy()
                cut = np.flatnonzero(bucket != bucket[-1])
                ready = int(cut[-1]) + 1 if cut.size else 0  # the last bucket may go on
                if ready:
                    yield from pairs(table.slice(0, ready))
                kept = [table.slice(ready)]
                rows = int(pc.sum(pc.binary_length(kept[0].column("posts"))).as_py() or 0) // (8 * POSTING)
        if rows:
            yield from pairs(pa.concat_tables(kept))

    return dealt.mapInArrow(run, PAIR)


def postings(classes: DataFrame, counts: np.ndarray, every: bool, wanted=None) -> DataFrame:
    """A row for each prefix token of each class, of ``wanted`` tokens only where that is given, in the line's own block of the token, or in ``every`` one."""
    held, blocks = classes.sparkSession.sparkContext.broadcast(counts), token_blocks(counts)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1 << 14):
                col = posting_columns(batch)
                if wanted is not None:
                    ok = wanted(col["token"])
                    col = {c: x[ok] for c, x in col.items()}
                k, own = blocks(held.value, col)
                at = np.repeat(np.arange(k.size), k) if every else np.arange(k.size)
                block = np.arange(at.size) - np.repeat(np.cumsum(k) - k, k) if every else own
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(col["doc_id"][at]), "line": pa.array(col["line"][at]), "n": pa.array(col["n"][at]), "sig": pa.array(col["sig"][at]), "sig2": pa.array(col["sig2"][at]), "place": pa.array(col["place"][at].astype(np.int32)), "token": pa.array(col["token"][at].view(np.int64)), "block": pa.array(block.astype(np.int32))})

    return classes.select("doc_id", "line", "n", "sig", "sig2", "tokens").mapInArrow(run, "doc_id long, line int, n int, sig long, sig2 long, place int, token long, block int")


def second_round(classes: DataFrame, open_: DataFrame, n_open: int, counts: np.ndarray, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs (b later, a earlier) of the ``n_open`` classes of ``open_`` (doc_b, line_b). A hot token's lines meet block by block."""
    asked = classes.join(open_.select(F.col("doc_b").alias("doc_id"), F.col("line_b").alias("line")), ["doc_id", "line"], "left_semi")
    asked = scratch.write(few_files(postings(asked, counts, True), 16 * n_open), "open-postings")
    b = asked.select(F.col("doc_id").alias("doc_b"), F.col("line").alias("line_b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"), F.col("sig2").alias("sig2_b"), F.col("place").alias("place_b"), "token", "block")
    posts = postings(classes, counts, False, maybe_token(asked.select("token")))
    least = F.ceil((F.col("n") + F.col("n_b")) * percent / (100 + percent))
    fits = (F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) >= least) & (F.greatest("n", "n_b") * percent <= F.least("n", "n_b") * 100)
    lacks = lambda x, y: F.bit_count(F.col(f"sig{x}").bitwiseAND(F.bitwise_not(f"sig{y}"))) + F.bit_count(F.col(f"sig2{x}").bitwiseAND(F.bitwise_not(f"sig2{y}")))
    fits &= (F.col("n") - lacks("", "_b") >= least) & (F.col("n_b") - lacks("_b", "") >= least)
    earlier = (F.col("doc_id") < F.col("doc_b")) | (F.col("doc_id") == F.col("doc_b")) & (F.col("line") < F.col("line_b"))
    return b.join(posts, ["token", "block"]).where(fits & earlier).select("doc_b", "line_b", F.col("doc_id").alias("doc_a"), F.col("line").alias("line_a")).distinct()


def line_sets(docs: DataFrame, pairs: DataFrame, scratch: Scratch, name: str, rows: int | None = None) -> DataFrame:
    """doc_id, line and words (the set, as bytes) of all lines that ``pairs`` (a written table) name, and of few others; no other texts are moved.

    With ``rows``, about how many lines these are, they are written in few files.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("doc_b").alias("doc_id"), F.col("line_b").alias("line")), F.struct(F.col("doc_a").alias("doc_id"), F.col("line_a").alias("line")))).alias("x")).select("x.*")
    wanted = maybe_among(ends)  # a line that several pairs name sets the same bits again

    def sets(batches):
        for whole in batches:
            for batch in slices(whole):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                raw, offsets = text_bytes(batch)
                at, row, number = line_offsets(raw, offsets)
                doc, number = ids[row], number.astype(np.int32)
                own = np.flatnonzero(wanted(doc, number))
                size = at[own + 1] - at[own]
                begin = np.concatenate([[0], np.cumsum(size)])
                taken = raw[np.arange(int(begin[-1])) + np.repeat(at[own] - begin[:-1], size)]
                found = [set_bytes(np.sort(hashed[a:b])) for _, hashed, where in word_chunks(taken, begin) for a, b in zip(where[:-1], where[1:])]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[own], pa.int64()), "line": pa.array(number[own], pa.int32()), "words": pa.array(found, pa.binary())})

    # What the filter lets through beyond the lines asked for is dropped by the joins of matched().
    found = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(sets, "doc_id long, line int, words binary")
    return scratch.write(found if rows is None else few_files(found, rows), f"{name}-sets")


def matched(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str, rows: int) -> DataFrame:
    """(doc_b, line_b) of the pairs whose lines' word sets are similar, ``rows`` at most."""
    side = lambda x: sets.select(F.col("doc_id").alias(f"doc_{x}"), F.col("line").alias(f"line_{x}"), F.col("words").alias(f"words_{x}"))
    joined = pairs.join(side("b"), ["doc_b", "line_b"]).join(side("a"), ["doc_a", "line_a"]).select("doc_b", "line_b", "words_b", "words_a")

    def check(batches):
        for whole in batches:
            for batch in slices(whole):
                ok = [similar(bytes_set(x), bytes_set(y), percent) for x, y in zip(batch.column("words_b").to_pylist(), batch.column("words_a").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("doc_b", "line_b")], names=["doc_b", "line_b"])

    return scratch.write(few_files(joined.mapInArrow(check, "doc_b long, line_b int").distinct(), rows), f"{name}-matched")


def repeated_lines(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and lines: the numbers (from 0) of the lines of a document that match an earlier line; one row a document that has any.

    Lines are cut at \\n and compared as sets of words (runs of characters other than space and \\x09 to \\x0D, A-Z as a-z).
    Lines match when 100 * intersection >= ``percent`` * union; a line is earlier by (doc_id, number). Lines of fewer than ``least_words`` distinct
    words are left alone. A line goes if any earlier line matches it, whether that one stays or not.

    Lines of equal sets are one class with its first line. A class's tokens are ordered by rarity in all texts; classes
    that share a token of their prefixes meet, pass length, positional and bitmap filters, and are verified.
    """
    tuned(spark)
    scratch = scratch or Scratch(spark, "lines")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def hashes(batch):
        for _, hashed, _ in word_chunks(*text_bytes(batch)):
            yield hashed

    counts = count_sketch(docs.select("text"), hashes)
    lines = scratch.write(line_classes(line_rows(docs, counts, percent, least_words)), "lines")
    classes = lines.where("tokens is not null")

    b, pair = ["doc_b", "line_b"], ["doc_b", "line_b", "doc_a", "line_a"]
    spread = token_counts(classes)
    # Pairs are dealt by their later line: votes are counted and the best candidate is told where they meet, with no shuffle of its own.
    met = candidates(classes, spread, percent).repartition(*b).groupBy(*pair).agg(F.count("*").alias("votes"))
    turn = F.row_number().over(Window.partitionBy(*b).orderBy(F.col("doc_a").isNull(), F.desc("votes"), F.desc("doc_a"), F.desc("line_a")))
    met = scratch.write(met.select(*pair, (turn == 1).alias("best")), "met")
    known, more = met.where("doc_a is not null"), met.where("doc_a is null")
    sets = line_sets(docs, known, scratch, "first")
    # The earlier line that shares most prefix tokens goes first; the other candidates matter only where that one doesn't match.
    best, other = known.where("best").select(*pair), known.where("not best").select(*pair)
    n_best = best.count()
    gone = matched(best, sets, percent, scratch, "best", n_best)
    gone = gone.unionByName(matched(other.join(gone, b, "left_anti"), sets, percent, scratch, "other", n_best - gone.count()))
    open_ = scratch.write(few_files(more.select(*b).distinct().join(gone, b, "left_anti"), more.count()), "open")
    if n_open := open_.count():
        rest = scratch.write(second_round(classes, open_, n_open, spread, percent, scratch).join(known.select(*pair), pair, "left_anti"), "rest")
        gone = gone.unionByName(matched(rest, line_sets(docs, rest, scratch, "second", 2 * rest.count()), percent, scratch, "rest", n_open))
    every = lines.where("tokens is null").select("doc_id", "line").unionByName(gone.select(F.col("doc_b").alias("doc_id"), F.col("line_b").alias("line")))
    return every.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs``, text without its repeated lines, and n_lines, n_removed; columns of these names are replaced.

    See ``repeated_lines`` for what goes. A null text stays null with 0 lines; a text whose lines all go is empty. A null doc_id's text
    stays as it is. Rows that repeat a doc_id count as one document at equal line numbers: equal rows all keep what one of
    them keeps. An empty table gives an empty result; lines of any length are compared whole.
    """
    scratch = Scratch(spark, "lines")
    found = scratch.write(repeated_lines(spark, docs, percent, least_words, scratch), "repeated")
    scratch.drop("lines", "met", "open", "open-postings", "rest", "first-sets", "second-sets", "best-matched", "other-matched", "rest-matched")
    kept = docs.drop("n_lines", "n_removed", "_id", "_lines")
    columns = [c for c in kept.columns if c != "text"]
    # The list of lines grows with the corpus, so it is merged with the texts and never broadcast.
    joined = kept.withColumn("_id", F.col("doc_id").cast("long")).join(found.select(F.col("doc_id").alias("_id"), F.col("lines").alias("_lines")).hint("merge"), "_id", "left")
    # A search for a byte: translate() would look up each character on its own.
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_lines", i)), "\n")
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(left)
    return joined.select(*columns, text.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("_lines"), F.lit(0)).alias("n_removed")).select(*kept.columns, "n_lines", "n_removed")
