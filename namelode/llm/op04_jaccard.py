"""Exact n-gram Jaccard join with set-relation skipping; classes of documents by links.

1. The exchange of ``shingles`` keeps the documents most of whose shingles are in other documents too: a document that links
   with another shares at least the threshold's part of its set. Equal sets are one from there on, and the exchange runs
   again among the different ones. It also gives every shingle's document frequency, the order of the index.
2. Index: each set lists its rarest shingles (prefix filter). A list is cut into windows by set size and into blocks by how
   many shingles a set has left from its position on. Of a block only that number's maximum and the smallest set size are
   looked at: blocks that leave too few for any set of the list are skipped whole, before any entry of theirs is read.
3. Lists are never turned into pairs. The smallest set of a list leads it; sets are gathered with their leader, in blocks of
   bounded size. There the leader's answer (the size of its intersection with every set) is counted from a small inverted
   index, and every other set's answer is derived from that of the set most like it that has one: what is counted are only
   the lists of the shingles by which the two differ.
4. Sets that link with the leader are linked with each other through it. Those that don't become a list of their own, led by the
   set that links with most others of its block, until they fit in a block or a leader links with few of them.
5. What is left are the sets near enough to link with such a set (Jaccard distance is a metric, so at most twice the threshold's
   distance from the leader) that no link has joined with the leader yet: they are compared with the sets that link with it. Of a
   list whose leader linked with few, what is outside its largest component is compared with all of it.
6. Links, already reduced to a forest by each task, are joined to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .components import components
from .shingles import SPACES, bucket_bits, exchange, set_rows, text_rows, unplanes

BLOCK_SETS, BLOCKS, MAX_BLOCK_SETS, BLOCK_TOKENS = 32, 256, 2048, 1 << 21
ENTRIES = "token long, rep long, n long, pos long"
#: Lists are led anew so often, while their leader links with one set in so many.
ROUNDS, ONE_IN = 12, 4
#: Of sets that are compared with other sets: blocks a side, and the most sets of one.
SIDES, MAX_SIDE_SETS = 16, 1024
LINK, NEAR, MIDDLE, REMOTE = -1, 0, 1, 2
FOUND = "leader long, a long, b long, n long, kind int"


def prefix_entries(sets: DataFrame, num: int, den: int) -> DataFrame:
    """The index entries of sets (rep, n, tokens with the rarest first; shingles of one set only come before and are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, n, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens = unplanes(data, 6)
                alone = n - len(tokens)
                pos = np.arange(alone, min(n, n - -(-n * num // den) + 1))
                if len(pos):
                    m = len(pos)
                    yield pa.record_batch([pa.array(tokens[:m].astype(np.int64)), pa.array(np.full(m, rep)), pa.array(np.full(m, n)), pa.array(pos)], ["token", "rep", "n", "pos"])

    return sets.mapInArrow(run, ENTRIES)


def joined(link: np.ndarray) -> np.ndarray:
    """For each row the smallest row it is connected with."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(np.where(link, label, len(link)).min(1, initial=len(link)), label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def counted(lists: np.ndarray, start: np.ndarray, count: np.ndarray, tokens: np.ndarray, sets: int) -> np.ndarray:
    """How many of the tokens each set has: their lists are read, and no others."""
    k = count[tokens]
    at = np.repeat(start[tokens] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
    return np.bincount(lists[at], minlength=sets)


def derived(sets: list[np.ndarray], asked: int) -> np.ndarray:
    """Sizes of the intersections of the first ``asked`` sets with all: each from the answer of the most similar one before it."""
    lengths = np.array([len(s) for s in sets])
    tokens, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    lists = np.repeat(np.arange(len(sets)), lengths)[np.argsort(column, kind="stable")]
    start = np.cumsum(count) - count
    own = np.split(column, np.cumsum(lengths)[:-1])
    out = np.zeros((asked, len(sets)), np.int64)
    mark = np.zeros(len(tokens), bool)
    for i in range(asked):
        apart = lengths[:i] + lengths[i] - 2 * out[:i, i]
        if i and apart[p := int(apart.argmin())] < lengths[i]:
            mark[own[p]] = True
            more = own[i][~mark[own[i]]]
            mark[own[p]] = False
            mark[own[i]] = True
            less = own[p][~mark[own[p]]]
            mark[own[i]] = False
            out[i] = out[p] + counted(lists, start, count, more, len(sets)) - counted(lists, start, count, less, len(sets))
        else:
            out[i] = counted(lists, start, count, own[i], len(sets))
    return out


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    return derived(left, len(left)) if left is right else derived(left + right, len(left))[:, len(left) :]


def linked(both: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    return (num + den) * both >= num * (na[:, None] + nb[None, :])


def forest(link: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    label = joined(link)
    return [(int(ids[i]), int(ids[label[i]])) for i in np.flatnonzero(label != np.arange(len(label)))]


def read_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return table["rep"].to_numpy(), table["n"].to_numpy(), [unplanes(t.as_py(), 6) for t in table["tokens"]]


def out_links(edges: list[tuple[int, int]], leader: int) -> pa.Table:
    a, b = zip(*edges) if edges else ((), ())
    return pa.table({"leader": pa.array([leader] * len(a), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([0] * len(a), pa.int64()), "kind": pa.array([LINK] * len(a), pa.int32())})


def index_lists(entries: DataFrame, num: int, den: int) -> DataFrame:
    """leader, rep, n: the sets of each list that reach it, with the list's smallest set, its leader; blocks that can't are skipped."""
    ratio = math.log(den / num) if num < den else 1.0
    window = F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int")  # sizes that link differ by less than two windows
    left = F.col("n") - F.col("pos")
    step = F.floor(F.log(left.cast("double")) / ratio * 4).cast("int")
    windowed = entries.select("token", "rep", "n", left.alias("left"), step.alias("block"), F.explode(F.array(window, window - 1)).alias("w"))
    blocks = windowed.groupBy("token", "w", "block").agg(F.min(F.struct("n", "rep")).alias("first"), F.max("left").alias("most"), F.count("*").alias("k"))
    lists = blocks.groupBy("token", "w").agg(F.min("first").alias("first"), F.sum("k").alias("k")).where("k > 1").select(F.col("token").alias("t"), F.col("w").alias("v"), F.col("first.n").alias("least"), F.col("first.rep").alias("leader"))
    enough = lambda left, n: F.expr(f"{left} * {num + den} >= {num} * ({n} + least)")
    kept = blocks.join(lists, (F.col("token") == F.col("t")) & (F.col("w") == F.col("v"))).where(enough("most", "first.n")).select("t", "v", F.col("block").alias("b"), "least", "leader")
    reach = windowed.join(kept, (F.col("token") == F.col("t")) & (F.col("w") == F.col("v")) & (F.col("block") == F.col("b"))).where(enough("left", "n"))
    return reach.select("leader", "rep", "n").distinct()


def compared(lists: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of lists (leader, rep, n; the leader among them), cut into blocks of bounded size that each hold the leader: the links of each
    block (LINK: a, b), and where a list has several blocks how far each set is from the leader (NEAR, MIDDLE, REMOTE: a is the set, n its
    size, b how many sets of its block it links with)."""
    size = lists.groupBy("leader").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("k > 1")
    per = F.least(F.greatest(F.lit(BLOCK_SETS), F.ceil(F.col("k") / BLOCKS)), F.lit(MAX_BLOCK_SETS))
    size = size.select("leader", F.greatest(F.ceil(F.col("k") / per), F.ceil(F.col("total") / BLOCK_TOKENS)).alias("blocks"))
    cells = lists.join(size, "leader").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).where("rep <> leader")
    heads = size.select("leader", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.col("leader").alias("rep"), "blocks")
    cells = cells.select("leader", "block", "rep", "blocks").unionByName(heads).join(sets.select("rep", "n", "tokens"), "rep")

    def block(table: pa.Table, leader: int) -> pa.Table:
        ids, n, tokens = read_sets(table)
        order = np.lexsort((n, ids != leader))  # the leader's answer is counted first
        ids, n, tokens = ids[order], n[order], [tokens[i] for i in order]
        both = derived(tokens, len(tokens))
        link = linked(both, n, n, num, den)
        links = out_links(forest(link, ids), leader)
        if table["blocks"][0].as_py() == 1:
            return links
        union = n + n[0] - both[0]
        level = np.where(link[0], NEAR, np.where(both[0] * den >= (2 * num - den) * union, MIDDLE, REMOTE))
        own = {"leader": np.full(len(ids) - 1, leader), "a": ids[1:], "b": link.sum(1)[1:], "n": n[1:], "kind": level[1:].astype(np.int32)}
        return pa.concat_tables([links, pa.table(own).cast(links.schema)])

    return cells.groupBy("leader", "block").applyInArrow(lambda key, t: block(t, key[0].as_py()), FOUND)


def asked_sets(levels: list[DataFrame], stalled: list[DataFrame], label: DataFrame) -> DataFrame:
    """part, leader, rep, n, side: sets (side 0) that are still to be compared with sets of side 1 of their part and leader.

    levels: what ``compared`` tells of each round's sets; stalled: lists no two sets of which need be compared yet; label: the
    components so far (node, component). Sets of one component are not asked about.
    """
    out = []
    for part, rows in enumerate(levels):
        rows = rows.join(label, F.col("rep") == F.col("node"), "left").select("leader", "rep", "n", "kind", F.coalesce("component", "rep").alias("c"))
        led = rows.select("leader").distinct().join(label, F.col("leader") == F.col("node"), "left").select(F.col("leader").alias("l"), F.coalesce("component", "leader").alias("own"))
        asking = rows.where(f"kind = {MIDDLE}").join(led, F.col("leader") == F.col("l")).where("c <> own")
        out.append((part, asking, rows.where(f"kind = {NEAR}")))
    for part, rows in enumerate(stalled, len(levels)):
        rows = rows.join(label, F.col("rep") == F.col("node"), "left").select("leader", "rep", "n", F.coalesce("component", "rep").alias("c"))
        most = rows.groupBy("leader", "c").agg(F.count("*").alias("k")).groupBy(F.col("leader").alias("l")).agg(F.max_by("c", F.struct("k", "c")).alias("own"))
        out.append((part, rows.join(most, F.col("leader") == F.col("l")).where("c <> own"), rows))
    columns = lambda rows, part, side: rows.select(F.lit(part).alias("part"), "leader", "rep", "n", F.lit(side).alias("side"))
    found = None
    for part, asking, answering in out:
        both = columns(asking, part, 0).unionByName(columns(answering.join(asking.select("leader").distinct(), "leader", "left_semi"), part, 1))
        found = both if found is None else found.unionByName(both)
    return found


def across_links(asked: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between the two sides of each part and leader. Sides are cut into a few blocks, and sets go to each block of the other side."""
    size = asked.groupBy("part", "leader", "side").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    per = F.least(F.greatest(F.lit(BLOCK_SETS), F.ceil(F.col("k") / SIDES)), F.lit(MAX_SIDE_SETS))
    size = size.withColumn("blocks", F.greatest(F.ceil(F.col("k") / per), F.ceil(F.col("total") / BLOCK_TOKENS)))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("blocks")))
    size = size.groupBy("part", "leader").agg(of(0).alias("ask"), of(1).alias("answer")).where("ask > 0 and answer > 0")
    rows = asked.join(size, ["part", "leader"])
    own = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks))
    every = lambda blocks: F.explode(F.expr(f"sequence(0L, {blocks} - 1)"))
    asking = rows.where("side = 0").select("part", "leader", "rep", "side", own("ask").alias("i"), every("answer").alias("j"))
    answering = rows.where("side = 1").select("part", "leader", "rep", "side", every("ask").alias("i"), own("answer").alias("j"))
    dealt = asking.unionByName(answering).join(sets.select("rep", "n", "tokens"), "rep")

    def across(table: pa.Table, leader: int) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("n", "ascending")])
        ids, n, tokens = read_sets(table)
        k = int((table["side"].to_numpy() == 0).sum())
        link = np.zeros((len(ids), len(ids)), bool)
        if 0 < k < len(ids):
            link[:k, k:] = linked(derived(tokens, k)[:, k:], n[:k], n[k:], num, den)
        return out_links(forest(link | link.T, ids), leader)

    return dealt.groupBy("part", "leader", "i", "j").applyInArrow(lambda key, t: across(t, key[1].as_py()), FOUND).select("a", "b")


def jaccard_links(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that connect what is connected among different sets (rep, n, tokens), and the tables that they are read from."""
    entries = written(prefix_entries(sets.select("rep", "n", "tokens"), num, den), "entries")
    lists = written(index_lists(entries, num, den), "members")
    forget(entries)
    tables, levels, stalled, links = [lists], [], [], None
    for turn in range(ROUNDS + 1):
        found = written(compared(lists, sets, num, den), "links")
        tables.append(found)
        more = found.where(f"kind = {LINK}").select("a", "b")
        links = more if links is None else links.unionByName(more)
        far = found.where(f"kind > {NEAR}").select("leader", F.col("a").alias("rep"), F.col("b").alias("degree"), "n")
        if not far.head(1):
            break
        levels.append(found.where(f"kind >= {NEAR}").select("leader", F.col("a").alias("rep"), "n", "kind"))
        # the first leader is the list's smallest set, later ones are chosen, so only their links tell whether to go on
        goes_on = F.lit(True) if turn == 0 else (F.col("near") * ONE_IN >= F.col("k")) & F.lit(turn < ROUNDS)
        near = levels[-1].groupBy("leader").agg(F.count("*").alias("k"), F.count(F.when(F.col("kind") == NEAR, 1)).alias("near")).select(F.col("leader").alias("l"), goes_on.alias("goes_on"))
        first = far.groupBy("leader").agg(F.max(F.struct("degree", (-F.col("rep")).alias("turned"))).alias("most")).join(near, F.col("leader") == F.col("l")).select("l", (-F.col("most.turned")).alias("head"), "goes_on")
        far = far.join(first, F.col("leader") == F.col("l"))
        stalled.append(far.where("not goes_on").select("leader", "rep", "n"))
        lists = written(far.where("goes_on").select(F.col("head").alias("leader"), "rep", "n").distinct(), "members")
        tables.append(lists)
    if not levels:
        return links, tables
    label = written(components(links), "labels")
    asked = written(asked_sets(levels, stalled[1:], label), "asked")
    links = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return links.unionByName(across_links(asked, sets, num, den)) if asked.head(1) else links, [*tables, label, asked]


def jaccard_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", table: bytes = SPACES) -> DataFrame:
    """doc_id, n_shingles, component_id: documents whose sets of shingles have a Jaccard similarity of num/den or more link;
    component_id is the smallest id that links reach.

    Words are what white space (ASCII) separates, A-Z lower-cased. A text of fewer than width words has one shingle; null
    texts and texts without words have none, link with nothing and keep their own id. Equal texts link. A null id gives a
    null component unless it links with others. Rows are kept as often as they come; rows of one id are linked, whatever their
    texts. Other columns are not read. Shingles are compared by 48-bit hashes: the
    intersection of two sets of n shingles each is miscounted with a probability of n * n / 2**48.
    """
    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    bits = bucket_bits(picked)
    every = written(exchange(text_rows(picked, width, bits, table), bits, num, den), "sets")
    alike = every.where("tokens is not null")
    reps = alike.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "tokens"), "doc_id").alias("set"))
    different = written(reps.select(F.col("rep").alias("doc_id"), "set.n", "fp", "set.tokens"), "reps")
    again = written(exchange(set_rows(different, bits), bits, num, den).where("tokens is not null").select(F.col("doc_id").alias("rep"), "n", "tokens"), "sets")
    links, tables = jaccard_links(again, num, den)
    rows = every.where("doc_id is not null").select("doc_id", "fp")
    several = rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("fp").alias("f")).where("k > 1 and (low <> high or f < k)").select(F.col("doc_id").alias("r_id"))
    several = written(several, "several") if several.head(1) else None  # ids whose rows are in several classes make them one
    classed = lambda found: different.select(F.col("fp").alias("f"), "doc_id").join(found, F.col("doc_id") == F.col("node"), "left").select("f", F.coalesce("component", "doc_id").alias("component"))
    if several is not None:
        own = rows.join(several, F.col("doc_id") == F.col("r_id")).join(different.select(F.col("fp").alias("f"), F.col("doc_id").alias("rep")), F.col("fp") == F.col("f"), "left")
        links = links.unionByName(own.select(F.col("doc_id").alias("a"), F.coalesce("rep", "doc_id").alias("b")).where("a <> b"))
    found = components(links)
    for table in (again, *tables):
        forget(table)
    result = every.join(classed(found), F.col("fp") == F.col("f"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    if several is not None:
        least = result.join(several, F.col("doc_id") == F.col("r_id")).groupBy("r_id").agg(F.min("component_id").alias("least"))
        result = result.join(least, F.col("doc_id") == F.col("r_id"), "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return result


def op4_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, num=85, den=100)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D]', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, hash(list_sort(s)) AS h FROM s),
u AS (SELECT doc_id, n, unnest(s) AS t FROM s JOIN n USING (doc_id)),
f AS (SELECT t FROM u GROUP BY t HAVING count(*) > 1),
g AS (SELECT u.* FROM u SEMI JOIN f USING (t)),
k AS (SELECT doc_id FROM g GROUP BY doc_id, n HAVING 100 * count(*) >= 85 * n),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
    WHERE a.doc_id IN (SELECT doc_id FROM k) AND b.doc_id IN (SELECT doc_id FROM k) GROUP BY ALL HAVING 185 * count(*) >= 85 * (any_value(a.n) + any_value(b.n))),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, n AS n_shingles, c AS component_id FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = doc_id
"""
