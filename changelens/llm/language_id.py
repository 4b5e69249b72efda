"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of each run of letters in both directions and labels every byte with
probabilities over the languages; a document's probabilities are the mean over all its bytes. Runs
are read one by one, so equal runs are labelled alike and a worker computes each once; a long run is
read in overlapping windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.llm.common import slices, stored

LETTERS = regex.compile(r"\p{L}+")
NO_LANGUAGE = "und"
HIDDEN = 16
# Bytes of a run that are labelled at once. Around each such stretch of a longer run, this many more are read for the states.
STRETCH, CONTEXT = 32, 16
# Labelled documents, and different runs of letters of them, that are learnt from for each language.
DOCS_PER_LANGUAGE = 400
RUNS_PER_LANGUAGE = 6000
STEPS, BATCH, RATE = 500, 256, 0.01
CACHED_RUNS = 300_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the runs as rows padded with zeros, and the runs' lengths."""
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    grid = np.zeros((len(runs), int(lengths.max())), np.int64)
    grid[np.arange(grid.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(runs), np.uint8)
    return grid, lengths


def mirrored(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's first ``length`` entries in reverse; the padding stays behind them."""
    at = np.arange(x.shape[1])
    at = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, at.reshape(*at.shape, *[1] * (x.ndim - 2)), axis=1)


class Direction:
    """One gated recurrent layer; the input weights of a byte are a row of a table."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.w = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)

    def forward(self, grid: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        n, steps, k = grid.shape[0], grid.shape[1], self.u.shape[0]
        h, out, saved = np.zeros((n, k), np.float32), np.empty((n, steps, k), np.float32), []
        for t in range(steps):
            x, r = self.w[grid[:, t]], h @ self.u
            gates = _sigmoid(x[:, : 2 * k] + r[:, : 2 * k])
            z, g = gates[:, :k], gates[:, k:]
            c = np.tanh(x[:, 2 * k :] + g * r[:, 2 * k :])
            new = z * h + (1 - z) * c
            if keep:
                saved.append((h, z, g, c, r[:, 2 * k :]))
            h = new
            out[:, t] = h
        return out, saved

    def backward(self, grid: np.ndarray, saved: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the tables, through time, given those of the outputs."""
        dw, du, dh = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(saved[0][0])
        for t in reversed(range(grid.shape[1])):
            h, z, g, c, rc = saved[t]
            dh = dh + d_out[:, t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dg = dc * rc * g * (1 - g)
            da = np.concatenate((dz, dg, dc), axis=1)
            np.add.at(dw, grid[:, t], da)
            dr = np.concatenate((dz, dg, dc * g), axis=1)
            du += h.T @ dr
            dh = dh * z + dr @ self.u.T
        return dw, du


class Network:
    """Both directions and the output layer; about 26,000 numbers whatever the corpus."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def label(self, grid: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Probabilities of every byte, and what the gradient needs."""
        fwd, saved_f = self.ahead.forward(grid, keep)
        turned = mirrored(grid, lengths)
        bwd, saved_b = self.back.forward(turned, keep)
        both = np.concatenate((fwd, mirrored(bwd, lengths)), axis=2)
        scores = both @ self.out + self.bias
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        return scores / scores.sum(axis=2, keepdims=True), (both, turned, saved_f, saved_b)

    def gradients(self, grid: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all bytes, by back-propagation through time."""
        p, (both, turned, saved_f, saved_b) = self.label(grid, lengths, keep=True)
        inside = np.arange(grid.shape[1]) < lengths[:, None]
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(target[:, None, None], (*grid.shape, 1)), np.take_along_axis(d, target[:, None, None], 2) - 1, 2)
        d = (d * inside[:, :, None] / inside.sum()).astype(np.float32)
        k = self.ahead.u.shape[0]
        d_both = d @ self.out.T
        wf, uf = self.ahead.backward(grid, saved_f, d_both[:, :, :k])
        wb, ub = self.back.backward(turned, saved_b, mirrored(d_both[:, :, k:], lengths))
        return [wf, uf, wb, ub, np.einsum("nth,ntl->hl", both, d), d.sum(axis=(0, 1))]

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.back.w, self.back.u, self.out, self.bias]

    def train(self, runs: list[bytes], target: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(runs), BATCH)
            grid, lengths = padded([runs[i] for i in chosen])
            rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m, v) in zip(self.parameters(), self.gradients(grid, lengths, target[chosen]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def totals(self, windows: list[tuple[bytes, int, int]]) -> np.ndarray:
        """For each window the sum of the probabilities of its labelled bytes, and their number last."""
        out = np.zeros((len(windows), len(self.languages) + 1), np.float32)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i][0]))
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            grid, lengths = padded([windows[i][0] for i in part])
            p, _ = self.label(grid, lengths)
            low, high = np.array([windows[i][1:] for i in part]).T
            place = np.arange(grid.shape[1])
            inside = (place >= low[:, None]) & (place < high[:, None])
            out[part, :-1] = (p * inside[:, :, None]).sum(axis=1)
            out[part, -1] = high - low
        return out


def runs_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall(text.lower())


def windows_of(run: str) -> list[tuple[bytes, int, int]]:
    """(bytes, first, end) of windows over a run: every byte is labelled in one of them, and no character is cut."""
    raw = run.encode("utf-8", "surrogatepass")
    if len(raw) <= STRETCH:
        return [(raw, 0, len(raw))]

    def start(at: int) -> int:
        at = min(max(at, 0), len(raw))
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    cuts = [start(i) for i in range(0, len(raw), STRETCH)] + [len(raw)]
    found = []
    for a, b in zip(cuts, cuts[1:]):
        low = start(a - CONTEXT)
        found.append((raw[low : start(b + CONTEXT)], a - low, b - low))
    return found


class Reader:
    """Labels texts; remembers a bounded number of short runs."""

    def __init__(self, network: Network):
        self.network = network
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(network.languages) + 1), np.float32)

    def learn(self, runs: list[str]) -> np.ndarray:
        cut = [windows_of(r) for r in runs]
        totals = self.network.totals([w for ws in cut for w in ws])
        starts = np.cumsum([0, *map(len, cut[:-1])])
        return np.add.reduceat(totals, starts, axis=0)

    def read(self, texts: list[str]) -> np.ndarray:
        """For each text the sums of its bytes' probabilities, and the number of its bytes last."""
        found = [runs_of(t) for t in texts]
        new = list(set().union(*found) - self.known.keys()) if found else []
        if len(self.known) + len(new) > CACHED_RUNS:
            self.known, self.rows = {}, self.rows[:0]
            new = list(set().union(*found))
        if new:
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate((self.rows, self.learn(new)))
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, runs in enumerate(found):
            at = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
            out[i] = self.rows[at].sum(axis=0, dtype=np.float64)
        return out


def held_out(id_: Column) -> Column:
    """Rows kept for testing; a row without an id is not."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_runs(docs: DataFrame, text: str, id_col: str, lang: str) -> DataFrame:
    """(lang, run): at most RUNS_PER_LANGUAGE different runs from at most DOCS_PER_LANGUAGE documents of each language.

    Documents are thinned by a hash of their id first, so that no language is sorted whole.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 2.0 * DOCS_PER_LANGUAGE / n + 20.0 / n))).otherwise(share)
    thin = rows.filter(draw <= share).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(draw, "id")))
    runs = thin.filter(F.col("rank") <= DOCS_PER_LANGUAGE).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("run"))
    runs = runs.distinct().withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("run"), "run")))
    return runs.filter(F.col("rank") <= RUNS_PER_LANGUAGE).select("lang", "run")


def trained(docs: DataFrame, text: str, id_col: str, lang: str) -> Network | None:
    rows = stored(training_runs(docs, text, id_col, lang)).orderBy("lang", "run").collect()
    if not rows:
        return None
    network = Network(sorted({r["lang"] for r in rows}))
    made = [(w[0], network.languages.index(r["lang"])) for r in rows for w in windows_of(r["run"])]
    network.train([p for p, _ in made], np.array([k for _, k in made]))
    return network


def languages(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; score is the mean probability of the predicted language.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing
    is labelled. Ties go to the first language by name. Repeated rows stay; an empty table gives an
    empty result; other columns are ignored.
    """
    network = trained(docs, text, id_col, lang)
    source = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value) if shared.value else None
        for batch in batches:
            names, scores = [], []
            for _, part in slices(batch.column("text")):
                if reader is None:
                    names += [NO_LANGUAGE] * len(part)
                    scores += [0.0] * len(part)
                    continue
                sums = reader.read(part)
                best = sums[:, :-1].argmax(axis=1)
                mean = sums[np.arange(len(part)), best] / np.maximum(sums[:, -1], 1)
                names += [reader.network.languages[b] if n else NO_LANGUAGE for b, n in zip(best, sums[:, -1])]
                scores += np.minimum(mean, 1.0).tolist()
            columns = [batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "lang_pred", "score"])

    kind = dict(source.dtypes)["id"]
    made = source.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
    return made.withColumnRenamed("id", id_col)
