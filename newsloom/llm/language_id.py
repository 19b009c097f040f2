"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions, labels every position and pools
the positions' probabilities over the document. It is small, written in numpy and trained by
backpropagation through time on a sample of labelled documents, bounded per label; prediction runs over the
whole text of every document, in segments whose states start afresh.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import query, ship, table
from newsloom.operators.ranking import with_position
from newsloom.session import materialize

HIDDEN = 8
#: The bound on the training sample, documents of each label, and what each one gives.
TRAIN_DOCS = 2_000
WINDOWS = 6
WINDOW_BYTES = 48
STEPS = 240
BATCH = 128
RATE = 0.02
SEGMENT_BYTES = 128
SEGMENTS = 2_048
UNKNOWN = "und"
#: A text is in no known language if its score is under SLACK times what all but LOW_SHARE of the held-out
#: documents of its length (classes in bytes) reach; a class, or all of them, counts from LEAST_HELD documents on.
SLACK = 0.8
LOW_SHARE = 0.01
LENGTHS = (0, 64, 256, 1_024)
LEAST_HELD = 20


@dataclass
class Network:
    """Weights: per direction the input table (256 x 3H), the recurrent weights (H x 2H, H x H); the output layer."""

    labels: list[str]
    weights: dict


def new_weights(labels: int, hidden: int, rng) -> dict:
    w = {}
    for d in ("f", "b"):
        w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        w[f"g{d}"] = rng.normal(0, 0.5 / hidden**0.5, (hidden, 2 * hidden))
        w[f"n{d}"] = rng.normal(0, 0.5 / hidden**0.5, (hidden, hidden))
    w["o"] = rng.normal(0, 0.3, (2 * hidden, labels))
    w["c"] = rng.normal(0, 0.01, labels)
    return {k: v.astype("float32") for k, v in w.items()}


def sigmoid(x):
    import numpy as np

    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_direction(w: dict, d: str, data, keep: bool):
    """Hidden states (T x B x H) of one direction; with ``keep`` also what training needs."""
    import numpy as np

    hidden = w[f"n{d}"].shape[0]
    table_, gates, cand = w[f"x{d}"], w[f"g{d}"], w[f"n{d}"]
    steps, rows = data.shape
    states = np.zeros((steps, rows, hidden), np.float32)
    kept = {}
    h = np.zeros((rows, hidden), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = table_[data[t]]
        zr = sigmoid(x[:, : 2 * hidden] + h @ gates)
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = np.tanh(x[:, 2 * hidden :] + (r * h) @ cand)
        if keep:
            kept[t] = (h, z, r, n)
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def gradients(w: dict, data, target):
    """Loss and gradients of the mean cross entropy over all positions, through time."""
    import numpy as np

    hidden = w["nf"].shape[0]
    sides = {d: run_direction(w, d, data, True) for d in ("f", "b")}
    both = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
    logits = both @ w["o"] + w["c"]
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    rows = np.arange(len(target))
    loss = -np.log(prob[:, rows, target] + 1e-9).mean()
    prob[:, rows, target] -= 1
    prob /= prob.shape[0] * prob.shape[1]
    g = {"o": np.einsum("tbh,tbc->hc", both, prob), "c": prob.sum(axis=(0, 1))}
    dboth = prob @ w["o"].T
    for d, lo in (("f", 0), ("b", hidden)):
        gx, gg, gn = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"g{d}"]), np.zeros_like(w[f"n{d}"])
        carry = np.zeros((data.shape[1], hidden), np.float32)
        order = range(data.shape[0] - 1, -1, -1) if d == "f" else range(data.shape[0])
        for t in order:
            h, z, r, n = sides[d][1][t]
            dh = carry + dboth[t][:, lo : lo + hidden]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            drh = dn @ w[f"n{d}"].T
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            gn += (r * h).T @ dn
            gg += h.T @ dzr
            np.add.at(gx, data[t], np.concatenate([dzr, dn], axis=1))
            carry = dh * z + drh * r + dzr @ w[f"g{d}"].T
        g |= {f"x{d}": gx, f"g{d}": gg, f"n{d}": gn}
    return loss, g


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 9) -> Network:
    """A network from (window, label) pairs; every label is drawn equally often."""
    import numpy as np

    labels = sorted({label for _, label in samples})
    if len(labels) < 2:
        return Network(labels, {})
    rng = np.random.default_rng(seed)
    own = {label: [] for label in labels}
    for x, y in samples:
        own[y].append(np.frombuffer(x.ljust(WINDOW_BYTES, b" ")[:WINDOW_BYTES], np.uint8))
    by = [np.array(own[label]) for label in labels]
    w = new_weights(len(labels), hidden, rng)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        target = rng.integers(0, len(labels), BATCH)
        data = np.stack([by[y][rng.integers(0, len(by[y]))] for y in target]).T
        _, g = gradients(w, data, target)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in g.values()))) / 1.0)
        for k, v in g.items():
            v = v / norm
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(labels, w)


def segment_sums(w: dict, segments, lengths):
    """Sum of the positions' label probabilities per segment (rows: segments, zero padded)."""
    import numpy as np

    out = np.empty((len(segments), w["o"].shape[1]), np.float64)
    hidden = w["nf"].shape[0]
    for at in range(0, len(segments), SEGMENTS):
        data = segments[at : at + SEGMENTS]
        size = lengths[at : at + SEGMENTS]
        back = data.copy()
        steps = int(size.max())
        # The backward direction must not start in the padding: short segments are shifted to the end.
        short = np.flatnonzero(size < steps)
        for i in short:
            back[i, steps - size[i] : steps] = data[i, : size[i]]
        hf, _ = run_direction(w, "f", np.ascontiguousarray(data[:, :steps].T), False)
        hb, _ = run_direction(w, "b", np.ascontiguousarray(back[:, :steps].T), False)
        for i in short:
            hb[: size[i], i] = hb[steps - size[i] :, i].copy()
        logits = hf.reshape(-1, hidden) @ w["o"][:hidden] + hb.reshape(-1, hidden) @ w["o"][hidden:] + w["c"]
        np.exp(logits - logits.max(axis=1, keepdims=True), out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        prob = logits.reshape(steps, len(data), -1)
        for i in short:
            prob[size[i] :, i] = 0
        out[at : at + SEGMENTS] = prob.sum(axis=0)
    return out


def document_probabilities(w: dict, texts: list[bytes]):
    """Mean over all positions of each text, empty texts uniform."""
    import numpy as np

    counts = np.array([-(-len(x) // SEGMENT_BYTES) for x in texts])
    sizes = np.array([len(x) for x in texts])
    out = np.full((len(texts), w["o"].shape[1]), 1 / w["o"].shape[1])
    total = int(counts.sum())
    if not total:
        return out
    segments = np.zeros((total, SEGMENT_BYTES), np.uint8)
    flat = segments.reshape(-1)
    starts = np.r_[0, np.cumsum(counts)]
    lengths = np.full(total, SEGMENT_BYTES)
    for i, x in enumerate(texts):
        if x:
            flat[starts[i] * SEGMENT_BYTES :][: len(x)] = np.frombuffer(x, np.uint8)
            lengths[starts[i + 1] - 1] = len(x) - (counts[i] - 1) * SEGMENT_BYTES
    sums = segment_sums(w, segments, lengths)
    some = counts > 0
    out[some] = np.add.reduceat(sums, starts[:-1][some], axis=0) / sizes[some, None]
    return out


def first_of_labels(docs: DataFrame, then: str, most: int) -> DataFrame:
    """``docs`` with k, a hash of the id: the first ``most`` rows of each label in the order of k and ``then``.

    Rows are counted by label and the first four digits of k, which map tasks combine; only rows up to
    the digits within which a label has its ``most`` are numbered. So a label that holds most of the
    table brings about ``most`` rows to one task and one row in 65,536 beside them.
    """
    docs = docs.withColumn("k", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    digits = F.substring("k", 1, 4)
    before = Window.partitionBy("lang").orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
    counts = docs.groupBy("lang", digits.alias("_digits")).agg(F.count("*").alias("_n"))
    ends = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < most)
    # Written down, the ends are known to be small: a row a label, and rows are cut where they are read.
    ends = materialize(ends.groupBy(F.col("lang").alias("_lang")).agg(F.max("_digits").alias("_last")), "label-ends")
    near = docs.join(ends, (F.col("lang") == F.col("_lang")) & (digits <= F.col("_last"))).drop("_lang", "_last")
    of_label = Window.partitionBy("lang").orderBy("k", then)
    return near.withColumn("number", F.row_number().over(of_label)).filter(F.col("number") <= most)


def training_windows(docs: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[bytes, str]]:
    """Windows spread over the texts of at most ``most`` documents of each label, in the order of a hash."""
    size = F.length("text")
    start = lambda i: (F.floor(size * i / WINDOWS) + 1).cast("int")
    windows = F.array(*[F.substring(F.col("text"), start(i), F.lit(WINDOW_BYTES)) for i in range(WINDOWS)])
    rows = (
        first_of_labels(docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", windows.alias("w")), "w", most)
        .orderBy("k", "lang", "w")
        .collect()
    )
    return [(x.encode(), r["lang"]) for r in rows for x in r["w"] if len(x) >= 8]


def held_out() -> Column:
    """Documents kept from training: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with lang_pred and score, the pooled probability of that label.

    ``und`` with score 0 stands for a null text, one without letters, and any text if there was
    nothing to learn from. Repeated rows are predicted each; an empty table gives an empty result;
    further columns pass through, but for those named like the new ones.
    """
    docs = docs.drop("lang_pred", "score")
    labels, w = network.labels, network.weights
    block = 4_000_000

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def blocks(texts):
            """Runs of texts of a few MB, so that a batch of long ones stays small in memory."""
            own, size = [], 0
            for x in texts:
                own.append(x)
                size += len(x)
                if size >= block:
                    yield own
                    own, size = [], 0
            if own:
                yield own

        def lettered(texts, at):
            """The bytes of the texts with letters one by one, their numbers put into ``at``."""
            for i, x in enumerate(texts):
                x = x.as_py()
                if x and any(map(str.isalpha, x)):
                    at.append(i)
                    yield x.encode()

        for texts in batches:
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at, done = [], 0
            for part in blocks(lettered(texts, at)) if labels else ():
                prob = document_probabilities(w, part) if len(labels) > 1 else np.ones((len(part), 1))
                best = prob.argmax(axis=1)
                for j, k in enumerate(best):
                    pred[at[done + j]] = labels[k]
                    score[at[done + j]] = float(np.clip(prob[j, k], 0, 1))
                done += len(part)
            yield pa.StructArray.from_arrays(
                [pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"]
            )

    # Only the texts go to Python and only predictions come back; the rows wait in Spark, which can spill them.
    predicted = F.arrow_udf(run, "lang_pred string, score double", F.ArrowUDFType.SCALAR_ITER)(F.col("text"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), predicted.alias("of"))
    return rows.select("row.*", "of.lang_pred", "of.score")


def learn(docs: DataFrame, most: int = TRAIN_DOCS) -> Network:
    """A network from the labelled rows of ``docs`` that are not held out."""
    return train(training_windows(docs.filter(~held_out()), most))


def identify(docs: DataFrame, learn_from: DataFrame | None = None, most: int = TRAIN_DOCS) -> DataFrame:
    """Learns from the labelled rows of ``learn_from`` (default ``docs``) that are not held out, predicts for all."""
    return predict(docs, learn(docs if learn_from is None else learn_from, most))


def length_class() -> Column:
    """The number of the class of ``LENGTHS`` that ``text`` is in."""
    return sum((F.octet_length("text") >= n).cast("int") for n in LENGTHS) - 1


def low_scores(scores: DataFrame, groups: list[str]) -> dict[tuple, tuple[int, float]]:
    """Of each group of ``scores``: its rows, and the score that all but LOW_SHARE of them reach.

    The rows are numbered by a range sort, so that no group is sorted in one task; a row a group comes back.
    """
    placed = with_position(scores.select(*groups, "score"), groups, [F.col("score")])
    sizes = materialize(placed.groupBy(*groups).agg(F.count("*").alias("n")), "score-counts")
    own = [F.col(f"_of_{g}") == F.col(g) for g in groups]
    at = F.col("position") == F.floor(LOW_SHARE * (F.col("n") - 1)) + 1
    sizes = sizes.select(*[F.col(g).alias(f"_of_{g}") for g in groups], "n")
    rows = placed.join(sizes, reduce(and_, own)).filter(at).collect()
    return {tuple(r[g] for g in groups): (r["n"], r["score"]) for r in rows}


def thresholds(predicted: DataFrame, network: Network) -> list[float]:
    """The least score of a text in a known language, per class of ``LENGTHS``.

    They come from all held-out labelled documents that the network labels rightly, whose predictions
    are in ``predicted`` (doc_id, text, lang, lang_pred, score; other rows do not count). Classes with few of
    them take the least of the others' thresholds; without enough in all, or a choice of labels,
    nothing is rejected.
    """
    none = [0.0] * len(LENGTHS)
    if len(network.labels) < 2:
        return none
    right = predicted.filter(held_out() & F.col("text").isNotNull() & (F.col("lang") == F.col("lang_pred")))
    scores = materialize(right.select(length_class().alias("class"), F.lit(0).alias("all"), "score"), "held-out-scores")
    every = low_scores(scores, ["all"]).get((0,), (0, 0.0))
    if every[0] < LEAST_HELD:
        return none
    of = low_scores(scores, ["class"])
    own = [of.get((i,), (0, 0.0)) for i in range(len(LENGTHS))]
    own = [SLACK * score if n >= LEAST_HELD else None for n, score in own]
    least = min([SLACK * every[1], *[x for x in own if x is not None]])
    return [least if x is None else x for x in own]


def least_score(limits: list[float]) -> Column:
    """The threshold that the length of ``text`` asks for."""
    out = F.lit(limits[0])
    for n, x in zip(LENGTHS[1:], limits[1:], strict=True):
        out = F.when(F.octet_length("text") >= n, F.lit(x)).otherwise(out)
    return out


@query("op9_language_id")
def op9(spark, sf):
    docs = table(spark, sf, "documents")
    predicted = identify(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"))
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


ship(__name__)
