"""Problem 3: consensus of several annotators, agreement, and reliability of each annotator.

Method: expectation-maximisation over per-annotator confusion matrices with smoothing. A unit is an item's sentiment
(three labels), an item and toxicity category, or an item and span marked by an annotator or the expert (both yes or
no). All votes on an item, from the vote tables and the sentences' arrays, and the expert's decision meet in one shuffle
and are written once as unit rows with their votes in them, and then as blocks of many units; a round reads the blocks,
computes the label posteriors in numpy with the confusion matrices at hand, and gives expected counts by (annotator, truth,
label), which are all that moves. Rounds end when the log likelihood of the votes rises by less than ``ENOUGH`` of itself a round.
Adjudicated units keep the expert's answer. Chance-corrected agreement (Cohen's kappa, the mean over all pairs of annotators, and toxicity
categories) is reported separately, over spans that some annotator marked.

The confusion matrices are a table of the annotators, not of the items: 17 numbers each. They stay a table, however many
annotators there are, and every block is joined to those of its own annotators, at most as many as it has votes; only
the labels' shares and the likelihood, eight numbers a round, pass the driver. Expected counts are summed as integers,
so results do not depend on how many annotators there are, nor on how tasks divide the units.

Arrays of annotated_sentences: element k is the answer of the item's k-th annotator by number; it counts where the vote
tables have no answer of that annotator. Items without vote rows have annotators -1, -2, ... by place.

Cases: null labels and repeated rows do not count, spelling is folded, "none" is the empty set; an annotator without
span rows marked nothing; a unit nobody judged gives nothing; two labels of one annotator for one item both count; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.session import cut

ENOUGH, MOST_ROUNDS = 1e-5, 60
#: Votes a block, at least if there are as many. Parts of 1 that expected counts and log likelihoods are summed in.
BLOCK, COUNT, LIKE, HALF = 1 << 17, 2.0**40, 2.0**20, 20
#: Added to every cell of a matrix, and more of it to its right answers: little is known of an annotator with few votes
#: but that they are better than chance.
SMOOTH, TRUST = 1.0, 3.0
# The label sets of the annotation tasks.
CATEGORIES = ("caste_slur", "religious", "gender", "general")
SENTIMENTS = ("negative", "neutral", "positive")
TASKS = ("sentiment", "toxicity", "ner")
#: Labels of each task, and where its cells begin among the 9 + 4 + 4 of an annotator.
SIZES, STARTS, CELLS = (3, 2, 2), (0, 9, 13), 17
_YES = ("no", "yes")


def vote_rows(s: SparkSession, d: str) -> DataFrame:
    """(item, kind, annotator, say): one row a vote or decision, whatever its table; ``say`` is text.

    Kinds: s sentiment, t categories, n a span, j took part, a arrays of a sentence, g expert."""
    none = F.lit(None).cast("int")
    sv = s.read.parquet(f"{d}/sentiment_votes.parquet").select(F.col("item_id").alias("item"), F.lit("s").alias("kind"), "annotator", F.lower(F.trim("label")).alias("say"))
    sv = sv.withColumn("say", F.coalesce("say", F.lit("")))
    tv = s.read.parquet(f"{d}/tox_votes.parquet").where("labels is not null").select(F.col("item_id").alias("item"), F.lit("t").alias("kind"), "annotator", F.array_join(F.transform("labels", lambda x: F.lower(F.trim(x))), " ").alias("say"))
    nv = s.read.parquet(f"{d}/span_votes.parquet").select(F.col("item_id").alias("item"), F.lit("n").alias("kind"), "annotator", F.concat_ws("|", "start", "end", "entity_type").alias("say"))
    spot = lambda p: F.concat_ws("|", p["start"], p["end"], p["entity_type"])
    a = s.read.parquet(f"{d}/annotated_sentences.parquet")
    arrays = F.struct("sentiment_annotator_labels", "toxicity_annotator_labels", F.transform("ner_annotator_spans", lambda x: F.transform(x, spot)).alias("spans"))
    a = a.select(F.col("sentence_id").alias("item"), F.lit("a").alias("kind"), none.alias("annotator"), F.to_json(arrays).alias("say"))
    g = s.read.parquet(f"{d}/adjudicated_items.parquet")
    decided = F.struct("sentiment", F.coalesce("toxicity_labels", F.array().cast("array<string>")).alias("tox"), F.coalesce(F.transform("ner_spans", spot), F.array().cast("array<string>")).alias("ner"))
    g = g.select(F.col("sentence_id").alias("item"), F.lit("g").alias("kind"), none.alias("annotator"), F.to_json(decided).alias("say"))
    return sv.unionByName(tv).unionByName(nv).unionByName(a).unionByName(g).where("item is not null")


def _units_of(item: str, rows: list[dict]) -> list[tuple]:
    """(task, item, sub, expert, annotators, labels) of an item; labels are places in the task's label set, for toxicity
    and its expert sets of bits by category; expert -1 if there is none."""
    import json

    rows = sorted(rows, key=lambda r: (r["kind"], r["annotator"] is not None, r["annotator"] or 0, r["say"]))
    sent: set[tuple[int, int]] = set()
    tox: dict[int, int] = {}
    marks: dict[int, set[str]] = {}
    judges: set[int] = set()
    arrays = expert = None
    for r in rows:
        k, who, say = r["kind"], r["annotator"], r["say"]
        if k == "a":
            arrays = arrays or json.loads(say)
        elif k == "g":
            expert = expert or json.loads(say)
        elif who is None:
            continue
        elif k == "s":
            judges.add(who)
            if say in SENTIMENTS:
                sent.add((who, SENTIMENTS.index(say)))
        elif k == "t":
            tox[who] = tox.get(who, 0) | sum(1 << i for i, c in enumerate(CATEGORIES) if c in say.split(" "))
        else:
            marks.setdefault(who, set()).add(say)
    if arrays:
        sl, tl, nl = (arrays.get(c) or [] for c in ("sentiment_annotator_labels", "toxicity_annotator_labels", "spans"))
        n = max(len(sl), len(tl), len(nl))
        people = sorted(judges) if len(judges) == n else [] if judges else [-1 - i for i in range(n)]
        told = {w for w, _ in sent}
        for i, who in enumerate(people):
            new = who not in judges
            if i < len(sl) and who not in told and (x := (sl[i] or "").strip().lower()) in SENTIMENTS:
                sent.add((who, SENTIMENTS.index(x)))
            if i < len(tl) and who not in tox and tl[i] is not None:
                tox[who] = sum(1 << k for k, c in enumerate(CATEGORIES) if c in {(x or "").strip().lower() for x in tl[i]})
            if i < len(nl) and nl[i] is not None and (new or who not in marks):
                marks.setdefault(who, set()).update(nl[i])
            if new:
                judges.add(who)
    out = []
    if sent:
        w, l = zip(*sorted(sent))
        e = expert["sentiment"] if expert and expert.get("sentiment") in SENTIMENTS else None
        out.append((0, item, "", SENTIMENTS.index(e) if e else -1, list(w), list(l)))
    if tox:
        w = sorted(tox)
        e = sum(1 << k for k, c in enumerate(CATEGORIES) if c in expert["tox"]) if expert else -1
        out.append((1, item, "", e, w, [tox[x] for x in w]))
    if judges:
        w = sorted(judges)
        gold = set(expert["ner"]) if expert else set()
        for sub in sorted(gold.union(*(marks.get(x, ()) for x in w))):
            out.append((2, item, sub, int(sub in gold) if expert else -1, w, [int(sub in marks.get(x, ())) for x in w]))
        if not any(o[0] == 2 for o in out):
            out.append((3, item, "", -1, w, [0] * len(w)))  # judged, nothing marked by anybody
    return out


_UNITS = "task int, item string, sub string, expert int, who array<int>, label array<int>"
_KINDS = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
_NAMES = ["task", "item", "sub", "expert", "who", "label"]


def _build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = [u for item, rows in zip(b.column("item").to_pylist(), b.column("rows").to_pylist()) for u in _units_of(item, rows)]
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def units(s: SparkSession, d: str) -> DataFrame:
    """The unit rows, written once. An item has as many votes as it has annotators, so its rows may meet in one array."""
    v = vote_rows(s, d).groupBy("item").agg(F.collect_set(F.struct("kind", "annotator", "say")).alias("rows"))
    return cut(v.mapInArrow(_build, _UNITS))


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit rows as blocks: (part, who, votes, names); in ``votes`` an annotator is a place in the sorted ``who``."""
    part, held, n = TaskContext.get().partitionId() << 32, [], 0
    for b in chain(it, [None]):
        if b is not None and b.num_rows:
            held.append(b)
            n += len(b.column("who").flatten())
        if held and (b is None or n >= BLOCK):
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            who, label = rows.column("who"), rows.column("label").flatten().cast(pa.int8())
            people, place = np.unique(who.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(who.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32))
            cols = [rows.column("task").cast(pa.int8()), rows.column("expert").cast(pa.int8()), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, label)]
            blobs = [_blob(pa.RecordBatch.from_arrays(cols, names=["task", "expert", "who", "label"])), _blob(rows.select(["item", "sub"]))]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([people], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in blobs)], names=["part", "who", "votes", "names"])
            part, held, n = part + 1, [], 0


_BLOCKS = "part bigint, who array<int>, votes binary, names binary"


def _blob(b: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_batch(b)
    return out.getvalue().to_pybytes()


def _batch(blob: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()


def _flat(b: pa.RecordBatch) -> Iterator[tuple]:
    """(task, unit rows, bit or -1, expert, unit of each vote, place of its annotator, its label), of a block's votes."""
    task = b.column("task").to_numpy(zero_copy_only=False)
    expert = b.column("expert").to_numpy(zero_copy_only=False)
    for t in (0, 1, 2):
        at = np.flatnonzero(task == t)
        if not len(at):
            continue
        who, label = (b.column(c).take(pa.array(at)) for c in ("who", "label"))
        n = who.value_lengths().to_numpy(zero_copy_only=False)
        unit = np.repeat(np.arange(len(at)), n)
        place = who.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        said = label.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for bit in range(4) if t == 1 else (-1,):
            e = expert[at]
            if t == 1:
                e = np.where(e < 0, -1, e >> bit & 1)
            yield t, at, bit, e, unit, place, (said >> bit & 1) if t == 1 else said


def _posterior(t: int, n: int, e: np.ndarray, unit: np.ndarray, place: np.ndarray, said: np.ndarray, conf: np.ndarray | None, prior: np.ndarray | None) -> tuple[np.ndarray, float]:
    """(units, labels) probabilities, and the log likelihood of the votes in parts of ``LIKE``; without matrices the share of the votes."""
    k = SIZES[t]
    z = np.zeros((n, k))
    if conf is None:
        np.add.at(z, (unit, said), 1.0)
        p, like = z / z.sum(1, keepdims=True), 0.0
    else:
        for truth in range(k):
            z[:, truth] = np.bincount(unit, conf[place, STARTS[t] + truth * k + said], n) + prior[(0, 3, 5)[t] + truth]
        top = z.max(1, keepdims=True)
        x = np.exp(z - top)
        total = x.sum(1, keepdims=True)
        p, like = x / total, float(np.rint((top + np.log(total)) * LIKE).sum())
    known = e >= 0
    p[known] = 0
    p[np.flatnonzero(known), e[known]] = 1
    return p, like


def _matrices(people: np.ndarray, counts: pa.ListScalar) -> np.ndarray | None:
    """Logs of the matrices of a block's annotators, in their order; none before the first round."""
    if not counts.is_valid:
        return None
    c = counts.values.field("c").flatten().to_numpy(zero_copy_only=False).reshape(-1, CELLS)
    order = np.argsort(counts.values.field("a").to_numpy(zero_copy_only=False))
    return maximise(np.concatenate([c[order].ravel(), np.zeros(8)]), len(people))[0]


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch, np.ndarray | None]]:
    for i in range(b.num_rows):
        people = b.column("who")[i].values.to_numpy(zero_copy_only=False)
        yield i, people, _batch(b.column("votes")[i]), _matrices(people, b.column("counts")[i])


def _expected(it: Iterator[pa.RecordBatch], prior: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Expected counts of each annotator of a block in parts of ``COUNT``, as two halves whose sums have room; those of no
    annotator are the units by truth and the likelihood."""
    for b in it:
        for _, people, votes, conf in _blocks(b):
            sums = np.zeros((len(people) + 1) * CELLS, np.int64)
            own = sums[len(people) * CELLS :]
            for t, at, _, e, unit, place, said in _flat(votes):
                p, like = _posterior(t, len(at), e, unit, place, said, conf, prior)
                q, k = np.rint(p * COUNT).astype(np.int64), SIZES[t]
                for truth in range(k):
                    np.add.at(sums, place * CELLS + STARTS[t] + truth * k + said, q[unit, truth])
                    own[(0, 3, 5)[t] + truth] += q[:, truth].sum()
                own[7] += int(like)
            halves = np.stack([sums >> HALF, sums & (1 << HALF) - 1]).reshape(2, -1, CELLS)
            yield pa.RecordBatch.from_arrays([pa.array([*people.tolist(), None], pa.int32()), *(pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), CELLS).cast(pa.list_(pa.int64())) for x in halves)], names=["a", "hi", "lo"])


def maximise(sums: np.ndarray, people: int) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the smoothed confusion matrices (annotator, cell) and of the labels' shares."""
    c = sums[: people * CELLS].reshape(people, CELLS)
    conf = np.empty_like(c)
    for k, start in zip(SIZES, STARTS):
        m = c[:, start : start + k * k].reshape(people, k, k)
        conf[:, start : start + k * k] = np.log((m + SMOOTH + TRUST * np.eye(k)) / (m.sum(2, keepdims=True) + k * SMOOTH + TRUST)).reshape(people, k * k)
    own = sums[people * CELLS : people * CELLS + 7]
    prior = np.concatenate([np.log((own[a:b] + 1) / (own[a:b].sum() + b - a)) for a, b in ((0, 3), (3, 5), (5, 7))])
    return conf, prior


def _answers(it: Iterator[pa.RecordBatch], prior: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(task, item, sub, label, p, votes) of every unit; ``votes`` has the annotators and whether each was right."""
    for i, people, votes, conf, names_of in ((*x, b.column("names")[x[0]]) for b in it for x in _blocks(b)):
        items, subs = (_batch(names_of).column(c) for c in ("item", "sub"))
        subs = subs.to_pylist()
        for t, at, bit, e, unit, place, said in _flat(votes):
            p, _ = _posterior(t, len(at), e, unit, place, said, conf, prior)
            best = p.argmax(1)
            right = said == best[unit]
            ends = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=len(at)))]).astype(np.int32)
            names = SENTIMENTS if t == 0 else _YES
            cols = [pa.array([TASKS[t]] * len(at)), items.take(pa.array(at)), pa.array([CATEGORIES[bit]] * len(at) if t == 1 else [subs[i] for i in at]), pa.array([names[x] for x in best]), pa.array(p[np.arange(len(at)), best])]
            cols += [pa.ListArray.from_arrays(pa.array(ends), pa.array(people[place].astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(right))]
            yield pa.RecordBatch.from_arrays(cols, names=["task", "item", "sub", "label", "p", "who", "right"])


_ANSWERS = "task string, item string, sub string, label string, p double, who array<int>, right array<boolean>"


def fitted(u: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray, list[float]]:
    """The units' blocks, (part, counts) of their annotators, the labels' shares, and the log likelihood after each round."""
    blocks = cut(u.where("task < 3").mapInArrow(_pack, _BLOCKS))
    near = cut(blocks.select("part", F.explode("who").alias("a")))
    held = blocks.select("part", "who", "votes").repartition("part").persist(StorageLevel.DISK_ONLY)
    of = held.withColumn("counts", F.lit(None).cast("array<struct<a:int,c:array<double>>>"))
    prior, likes = None, []
    for _ in range(MOST_ROUNDS):
        part = of.mapInArrow(lambda it, p=prior: _expected(it, p), "a int, hi array<bigint>, lo array<bigint>")
        sums = cut(part.groupBy("a").agg(F.array(*(F.sum(F.get("hi", F.lit(i))) * (2.0**HALF / COUNT) + F.sum(F.get("lo", F.lit(i))) / COUNT for i in range(CELLS))).alias("c")))
        own = next((np.array(r.c) for r in sums.where("a is null").collect()), np.zeros(CELLS))
        prior = maximise(own[:8], 0)[1]
        likes.append(float(own[7]) * COUNT / LIKE)
        counts = sums.where("a is not null").join(near, "a").groupBy("part").agg(F.collect_list(F.struct("a", "c")).alias("counts"))
        of = held.join(counts, "part")
        if len(likes) > 2 and likes[-1] - likes[-2] <= ENOUGH * abs(likes[-2]):
            break
    held.unpersist()
    return blocks, counts, prior, likes


def answers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The answer to every unit, and the units."""
    u = units(s, d)
    blocks, counts, prior, _ = fitted(u)
    return blocks.join(counts, "part").mapInArrow(lambda it: _answers(it, prior), _ANSWERS), u


def joined_answers(u: DataFrame, rounds: int) -> DataFrame:
    """The answers after so many rounds by joins of single votes, for comparison in tests; no query takes this way."""
    bits = F.when(F.col("task") == 1, F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(-1)))
    one = lambda c: F.when((F.col("bit") < 0) | (c < 0), c).otherwise((c.bitwiseAND(F.expr("shiftleft(1, greatest(bit, 0))")) != 0).cast("int"))
    v = u.where("task < 3").withColumn("bit", F.explode(bits)).select("task", "item", "sub", "bit", one(F.col("expert")).alias("expert"), F.explode(F.zip_with("who", "label", lambda w, l: F.struct(w.alias("who"), l.alias("label")))).alias("v"))
    v = cut(v.select("task", "item", "sub", "bit", "expert", F.col("v.who").alias("who"), one(F.col("v.label")).alias("said")))
    unit, k = ["task", "item", "sub", "bit"], F.when(F.col("task") == 0, 3).otherwise(2)
    each = v.withColumn("truth", F.explode(F.sequence(F.lit(0), k - 1)))
    share = v.groupBy(*unit, F.col("said").alias("truth")).agg((F.count("*") / F.first(F.lit(1.0))).alias("n"))
    total = v.groupBy(*unit).agg(F.count("*").alias("all"), F.first("expert").alias("expert"))
    post = share.join(total, unit).select(*unit, "truth", F.when(F.col("expert") >= 0, (F.col("expert") == F.col("truth")).cast("double")).otherwise(F.col("n") / F.col("all")).alias("p"))
    missing = total.where("expert >= 0").select(*unit, F.col("expert").alias("truth"), F.lit(1.0).alias("p"))
    post = cut(post.unionByName(missing).groupBy(*unit, "truth").agg(F.max("p").alias("p")))
    for _ in range(rounds):
        c = cut(each.join(post, [*unit, "truth"]).groupBy("task", "who", "truth", "said").agg(F.sum("p").alias("c")))
        t = c.groupBy("task", "who", "truth").agg(F.sum("c").alias("t"))
        cells = v.select("task", "who").distinct().withColumn("truth", F.explode(F.sequence(F.lit(0), k - 1))).withColumn("said", F.explode(F.sequence(F.lit(0), k - 1)))
        conf = cells.join(c, ["task", "who", "truth", "said"], "left").join(t, ["task", "who", "truth"], "left").select("task", "who", "truth", "said", F.log((F.coalesce("c", F.lit(0.0)) + SMOOTH + F.when(F.col("truth") == F.col("said"), TRUST).otherwise(0.0)) / (F.coalesce("t", F.lit(0.0)) + k * SMOOTH + TRUST)).alias("l"))
        prior = post.groupBy("task", "truth").agg(F.sum("p").alias("own"))
        prior = prior.join(post.groupBy("task").agg(F.sum("p").alias("all")), "task").select("task", "truth", F.log((F.col("own") + 1) / (F.col("all") + k)).alias("prior"))
        z = each.join(conf, ["task", "who", "truth", "said"]).groupBy(*unit, "truth").agg(F.sum("l").alias("l"), F.first("expert").alias("expert")).join(F.broadcast(prior), ["task", "truth"])
        z = z.groupBy(*unit).agg(F.first("expert").alias("expert"), F.collect_list(F.struct("truth", (F.col("l") + F.col("prior")).alias("z"))).alias("zs"))
        top = F.array_max(F.transform("zs", lambda x: x["z"]))
        z = z.withColumn("top", top).withColumn("sum", F.aggregate("zs", F.lit(0.0), lambda a, x: a + F.exp(x["z"] - F.col("top")))).select(*unit, "expert", "top", "sum", F.explode("zs").alias("x"))
        post = cut(z.select(*unit, F.col("x.truth").alias("truth"), F.when(F.col("expert") >= 0, (F.col("expert") == F.col("x.truth")).cast("double")).otherwise(F.exp(F.col("x.z") - F.col("top")) / F.col("sum")).alias("p")))
    best = post.groupBy(*unit).agg(F.max(F.struct("p", (-F.col("truth")).alias("m"))).alias("b")).select(*unit, F.col("b.p").alias("p"), (-F.col("b.m")).alias("best"))
    r = v.join(best, unit).groupBy(*unit, "best", "p").agg(F.array_sort(F.collect_list(F.struct("who", (F.col("said") == F.col("best")).alias("right")))).alias("vs"))
    name = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    label = F.when(F.col("task") == 0, name(SENTIMENTS, F.col("best"))).otherwise(name(_YES, F.col("best")))
    sub = F.when(F.col("task") == 1, name(CATEGORIES, F.col("bit"))).otherwise(F.col("sub"))
    return r.select(name(TASKS, F.col("task")).alias("task"), "item", sub.alias("sub"), label.alias("label"), "p", F.col("vs.who").alias("who"), F.col("vs.right").alias("right"))


def consensus(s: SparkSession, d: str) -> DataFrame:
    """(sentence_id, sentiment, sentiment_p, toxicity_labels, toxicity_p, ner_spans, ner_p): one row a judged sentence; the
    p of a set is that of its least certain member or non-member; null where the task has no votes."""
    a, u = answers(s, d)
    yes = F.when(F.col("label") == "yes", F.col("sub"))
    spot = F.split(F.when((F.col("task") == "ner") & (F.col("label") == "yes"), F.col("sub")), r"\|")
    span = F.when(spot.isNotNull(), F.struct(F.get(spot, F.lit(0)).cast("int").alias("start"), F.get(spot, F.lit(1)).cast("int").alias("end"), F.get(spot, F.lit(2)).alias("entity_type")))
    is_ = lambda t: F.col("task") == t
    blank = u.where("task = 3").select(F.lit("ner").alias("task"), "item", F.lit("").alias("sub"), F.lit("no").alias("label"), F.lit(1.0).alias("p"))
    g = a.select("task", "item", "sub", "label", "p").unionByName(blank).groupBy(F.col("item").alias("sentence_id")).agg(
        F.max(F.when(is_("sentiment"), F.col("label"))).alias("sentiment"), F.max(F.when(is_("sentiment"), F.col("p"))).alias("sentiment_p"),
        F.array_sort(F.collect_set(F.when(is_("toxicity"), yes))).alias("_tox"), F.min(F.when(is_("toxicity"), F.col("p"))).alias("toxicity_p"),
        F.array_sort(F.collect_set(span)).alias("_ner"), F.min(F.when(is_("ner"), F.col("p"))).alias("ner_p"),
    )
    return g.select("sentence_id", "sentiment", "sentiment_p", F.when(F.col("toxicity_p").isNotNull(), F.col("_tox")).alias("toxicity_labels"), "toxicity_p", F.when(F.col("ner_p").isNotNull(), F.col("_ner")).alias("ner_spans"), "ner_p")


def reliability(s: SparkSession, d: str) -> DataFrame:
    """(annotator, task, items, right): right is the whole label, label set or span set of the item. Annotators of items
    without vote rows have no number and are left out."""
    a, u = answers(s, d)
    j = a.select("task", "item", F.explode(F.arrays_zip("who", "right")).alias("v"))
    by = j.groupBy("task", "item", F.col("v.who").alias("annotator")).agg(F.bool_and("v.right").alias("ok"))
    blank = u.where("task = 3").select(F.lit("ner").alias("task"), "item", F.explode("who").alias("annotator"), F.lit(True).alias("ok"))
    return by.unionByName(blank).where("annotator >= 0").groupBy("annotator", "task").agg(F.count("*").alias("items"), F.count_if("ok").alias("right"))


def agreement(s: SparkSession, d: str) -> DataFrame:
    """(task, kappa, pairs, votes): pairs with a figure, and the pairs of votes compared. Equal
    answers throughout give 1, but no figure (null, left out of the mean) where all of a pair's sentiments are one label."""
    u = units(s, d).where("task < 3 and (task < 2 or exists(label, x -> x > 0))")
    bits = F.when(F.col("task") == 1, F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(-1)))
    u = u.select("task", "who", "label", F.explode(bits).alias("bit"))
    value = lambda l: F.when(F.col("bit") < 0, l).otherwise((l.bitwiseAND(F.expr("shiftleft(1, greatest(bit, 0))")) != 0).cast("int"))
    u = u.select("task", "bit", F.zip_with("who", "label", lambda w, l: F.struct(w.alias("a"), value(l).alias("l"))).alias("v"))
    u = u.select("task", "bit", F.explode("v").alias("a"), "v").select("task", "bit", "a", F.explode(F.filter("v", lambda x: x["a"] > F.col("a.a"))).alias("b"))
    sums = [F.count_if(F.col(f"{x}.l") == i).alias(f"{x}_{i}") for x in "ab" for i in range(3)]
    g = u.groupBy("task", "bit", F.col("a.a").alias("a"), F.col("b.a").alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("a.l") == F.col("b.l")).alias("same"), *sums)
    chance = sum(F.col(f"a_{i}").cast("double") * F.col(f"b_{i}") for i in range(3)) / (F.col("n").cast("double") * F.col("n"))
    k = F.when((F.col("same") == F.col("n")) & (F.col("task") != 0), 1.0).otherwise(F.try_divide(F.col("same") / F.col("n") - chance, 1 - chance))
    g = g.withColumn("k", k).groupBy("task").agg(F.avg("k").alias("kappa"), F.count("k").alias("pairs"), F.sum("n").alias("votes"))
    return g.select(F.get(F.array(*map(F.lit, TASKS)), F.col("task")).alias("task"), "kappa", "pairs", "votes")


def p3_agreement(s: SparkSession, d: str) -> DataFrame:
    return agreement(s, d).withColumn("kappa", F.round("kappa", 9))


def p3_units(s: SparkSession, d: str) -> DataFrame:
    """(task, item, sub, label, p): the answer to every unit."""
    return answers(s, d)[0].drop("who", "right")


def p3_consensus(s: SparkSession, d: str) -> DataFrame:
    return consensus(s, d)


def p3_reliability(s: SparkSession, d: str) -> DataFrame:
    return reliability(s, d)


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return reliability(s, d).where("right < 0.5 * items").select("annotator", "task")


_PAIRS = "count(*) AS n, count(*) FILTER (u.l = w.l) AS same, " + " + ".join(f"count(*) FILTER (u.l = {i})::DOUBLE * count(*) FILTER (w.l = {i})" for i in range(3)) + " AS chance"
SQL = {
    "p3_agreement": f"""WITH j AS (SELECT DISTINCT item_id AS item, annotator FROM sentiment_votes),
jl AS (SELECT item, list(annotator ORDER BY annotator) AS who FROM j GROUP BY 1),
d AS (SELECT DISTINCT ON (sentence_id) sentence_id AS item, coalesce(sentiment_annotator_labels, []) AS sl, coalesce(toxicity_annotator_labels, []) AS tl, coalesce(ner_annotator_spans, []) AS nl FROM annotated_sentences ORDER BY sentence_id),
e AS (SELECT d.*, greatest(len(sl), len(tl), len(nl)) AS n, jl.who AS judges FROM d LEFT JOIN jl USING (item)),
p AS (SELECT item, i, CASE WHEN judges IS NULL THEN -i::INT ELSE judges[i] END AS annotator, judges IS NULL AS new, sl[i] AS s, tl[i] AS t, nl[i] AS spans FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM e WHERE judges IS NULL OR len(judges) = n)),
names AS (SELECT * FROM (VALUES ('negative', 0), ('neutral', 1), ('positive', 2)) t(name, l)), cats AS (SELECT * FROM (VALUES ('caste_slur', 0), ('religious', 1), ('gender', 2), ('general', 3)) t(name, bit)),
st AS (SELECT DISTINCT item_id AS item, annotator, l FROM sentiment_votes JOIN names ON lower(trim(label)) = name),
s AS (SELECT * FROM st UNION SELECT item, annotator, l FROM p JOIN names ON lower(trim(s)) = name WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.item = p.item AND st.annotator = p.annotator)),
tt AS (SELECT item_id AS item, annotator, list_transform(flatten(list(labels)), lambda x: lower(trim(x))) AS ls FROM tox_votes WHERE labels IS NOT NULL GROUP BY 1, 2),
tu AS (SELECT * FROM tt UNION ALL SELECT item, annotator, list_transform(t, lambda x: lower(trim(x))) FROM p WHERE t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tt WHERE tt.item = p.item AND tt.annotator = p.annotator)),
x AS (SELECT item, annotator, bit, list_contains(ls, name)::INT AS l FROM tu, cats),
mt AS (SELECT DISTINCT item_id AS item, annotator, start || '|' || "end" || '|' || entity_type AS sub FROM span_votes),
m AS (SELECT * FROM mt UNION SELECT item, annotator, z.start || '|' || z."end" || '|' || z.entity_type FROM (SELECT item, annotator, new, unnest(spans) AS z FROM p) p WHERE new OR NOT EXISTS (SELECT 1 FROM mt WHERE mt.item = p.item AND mt.annotator = p.annotator)),
k AS (SELECT * FROM j UNION SELECT item, annotator FROM p WHERE new),
y AS (SELECT b.item, b.sub, k.annotator, (m.sub IS NOT NULL)::INT AS l FROM (SELECT DISTINCT m.item, sub FROM m JOIN k ON k.item = m.item AND k.annotator = m.annotator) b JOIN k ON k.item = b.item LEFT JOIN m ON m.item = b.item AND m.sub = b.sub AND m.annotator = k.annotator),
g AS (SELECT 'sentiment' AS task, 0 AS bit, u.annotator AS a, w.annotator AS b, {_PAIRS} FROM s u JOIN s w ON u.item = w.item AND u.annotator < w.annotator GROUP BY ALL
UNION ALL SELECT 'toxicity', u.bit, u.annotator, w.annotator, {_PAIRS} FROM x u JOIN x w ON u.item = w.item AND u.bit = w.bit AND u.annotator < w.annotator GROUP BY ALL
UNION ALL SELECT 'ner', 0, u.annotator, w.annotator, {_PAIRS} FROM y u JOIN y w ON u.item = w.item AND u.sub = w.sub AND u.annotator < w.annotator GROUP BY ALL),
f AS (SELECT task, n, CASE WHEN same = n AND task <> 'sentiment' THEN 1.0 ELSE (same / n - chance / (n::DOUBLE * n)) / nullif(1 - chance / (n::DOUBLE * n), 0) END AS k FROM g)
SELECT task, round(avg(k), 9)::DOUBLE AS kappa, count(k) AS pairs, sum(n)::BIGINT AS votes FROM f GROUP BY 1""",
}
