"""Secret scans: fixed patterns, and a character convolutional network that judges every other candidate in its context.

Candidates are runs of at least ``LEAST`` characters of keys, tokens and paths, and the parts of runs outside the patterns' findings; long ones are
looked at whole, in overlapping windows. The network is written in numpy: embedded characters, one convolution,
a maximum over positions, a hidden layer. It is trained on labelled findings: candidates that a pattern finds are secrets, the others are not;
secrets found by a keyword are shown without it as well, so that the network has to know them by their looks. Scores are
calibrated on findings kept aside, and the threshold is the largest that still finds ``RECALL`` of the secrets there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from kindred.llm.common import materialise, only_cache, text_or_empty, via_arrow

# The patterns of the base rules and their least lengths.
KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

LEAST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEFT, TOKEN, RIGHT = 24, 48, 16
WIDTH = LEFT + TOKEN + RIGHT
STRIDE = 16
SYMBOLS = 128

# Training windows that are learnt from one after another; beyond that, groups of about as many start each round from the mean of the last one.
GROUP = 8192
ROUNDS = 8
# Groups of sums that reach the driver; steps that a logit of 1 has in the counts by which scores are calibrated.
BUFFERS, STEPS, MOST_LOGIT = 32, 1000, 30
# Every fourth window is kept aside. A class with less than this share of the other weighs as if it had that share.
ASIDE, LEAST_SHARE = 4, 1 / 16
SCORED = 4096
RECALL = 0.98
LEAST_STEPS = 250


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    # Access keys and hexadecimal strings of these lengths lie inside candidate runs.
    for start, end in candidates(text) if runs is None else runs:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text, start, end) if m.end() - m.start() >= LEAST_ACCESS]
        if end - start >= LEAST_HEX:
            found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, start, end) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


def parts_outside(runs: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """What base spans leave of the runs, in parts of at least ``LEAST`` characters."""
    covered: list[list[int]] = []
    for start, end, _ in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(end, covered[-1][1])
        else:
            covered.append([start, end])
    i = 0
    for at, end in runs:
        while i < len(covered) and covered[i][1] <= at:
            i += 1
        k = i
        while k < len(covered) and covered[k][0] < end:
            if covered[k][0] - at >= LEAST:
                yield at, covered[k][0]
            at, k = max(at, covered[k][1]), k + 1
        if end - at >= LEAST:
            yield at, end


def slices(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The places of a run that are shown: the run, or of a long one all stretches of ``TOKEN`` characters, ``STRIDE`` apart."""
    for at in range(start, max(start, end - TOKEN), STRIDE):
        yield at, at + TOKEN
    yield max(start, end - TOKEN), end


def window(text: str, start: int, end: int) -> bytes:
    """A candidate of at most ``TOKEN`` characters between its contexts, one byte per character."""
    left, token, right = text[max(0, start - LEFT) : start], text[start:end], text[end : end + RIGHT]
    shown = left.rjust(LEFT, "\0") + token.ljust(TOKEN, "\0") + right.ljust(RIGHT, "\0")
    return bytes(min(ord(c), SYMBOLS - 1) for c in shown)


def training_windows(text: str) -> Iterator[tuple[bytes, int]]:
    """Candidates of a text, 1 for those that a pattern finds. Of a run longer than ``TOKEN``, slices with at least ``LEAST`` characters of a
    finding count as found."""
    runs = candidates(text)
    base = base_spans(text, runs)
    first = 0
    for run in runs:
        while first < len(base) and base[first][1] <= run[0]:
            first += 1
        near = []
        for k in range(first, len(base)):
            if base[k][0] >= run[1]:
                break
            near.append(base[k])
        least = 1 if run[1] - run[0] <= TOKEN else LEAST
        i = 0
        for a, b in slices(*run) if near else ():
            while i < len(near) and near[i][1] <= a:
                i += 1
            for k in range(i, len(near)):
                if near[k][0] >= b:
                    break
                if min(b, near[k][1]) - max(a, near[k][0]) >= least:
                    yield window(text, a, b), 1
                    break
    for part in parts_outside(runs, base):
        for a, b in slices(*part):
            yield window(text, a, b), 0
    for m in _ASSIGN.finditer(text) if any(kind == "assign" for _, _, kind in base) else ():
        if len(m[2]) >= LEAST:
            around = text[max(0, m.start() - LEFT) : m.start()]
            bare = around + m[2] + text[m.end() : m.end() + RIGHT]
            for a, b in slices(len(around), len(around) + len(m[2])):
                yield window(bare, a, b), 1


class Model:
    """The network. Without a labelled finding, or with nothing else to tell it from, it finds nothing."""

    EMBED, FILTERS, SPAN, HIDDEN = 8, 32, 5, 16

    def __init__(self) -> None:
        self.threshold, self.slope, self.shift = np.inf, 1.0, 0.0
        rng = np.random.default_rng(11)
        normal = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        embed = (rng.standard_normal((SYMBOLS, self.EMBED)) * 0.3).astype(np.float32)
        self.p = {
            "embed": embed, "conv": normal((self.EMBED + 1) * self.SPAN, self.FILTERS), "conv0": np.zeros(self.FILTERS, np.float32),
            "hidden": normal(2 * self.FILTERS, self.HIDDEN), "hidden0": np.zeros(self.HIDDEN, np.float32),
            "out": normal(self.HIDDEN, 1), "out0": np.zeros(1, np.float32),
        }

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, n, steps = self.p, len(x), WIDTH - self.SPAN + 1
        inside = np.zeros((n, WIDTH, 1), np.float32)
        inside[:, LEFT : LEFT + TOKEN, 0] = x[:, LEFT : LEFT + TOKEN] > 0
        grid = np.concatenate([p["embed"][x], inside], axis=2)
        patches = np.concatenate([grid[:, i : i + steps] for i in range(self.SPAN)], axis=2)
        conv = patches @ p["conv"] + p["conv0"]
        # Over the candidate and over its context by themselves.
        token = np.zeros(steps, bool)
        token[LEFT : LEFT + TOKEN - self.SPAN + 1] = True
        pools = []
        for part in (np.flatnonzero(token), np.flatnonzero(~token)):
            at = part[conv[:, part].argmax(axis=1)]
            pools.append((at, np.take_along_axis(conv, at[:, None], axis=1)[:, 0]))
        pooled = np.maximum(np.concatenate([v for _, v in pools], axis=1), 0)
        hidden = np.maximum(pooled @ p["hidden"] + p["hidden0"], 0)
        return (hidden @ p["out"] + p["out0"])[:, 0], (x, patches, pools, pooled, hidden)

    def _backward(self, slope: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        p, (x, patches, pools, pooled, hidden) = self.p, kept
        g = {"out": hidden.T @ slope[:, None], "out0": slope.sum(keepdims=True)}
        d = slope[:, None] * p["out"].T * (hidden > 0)
        g["hidden"], g["hidden0"] = pooled.T @ d, d.sum(0)
        d = (d @ p["hidden"].T) * (pooled > 0)
        g["conv"], g["conv0"], g["embed"] = np.zeros_like(p["conv"]), d.reshape(len(x), 2, -1).sum((0, 1)), np.zeros_like(p["embed"])
        rows, width = np.arange(len(x)), self.EMBED + 1
        for k, (at, _) in enumerate(pools):
            for f in range(self.FILTERS):
                pull = d[:, k * self.FILTERS + f]
                used = np.flatnonzero(pull)
                if not len(used):
                    continue
                g["conv"][:, f] += pull[used] @ patches[rows[used], at[used, f]]
                for i in range(self.SPAN):
                    np.add.at(g["embed"], x[used, at[used, f] + i], pull[used, None] * p["conv"][i * width : i * width + self.EMBED, f])
        return g

    @staticmethod
    def _array(windows: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)

    def fit(self, windows: list[bytes], labels: list[int], epochs: int = 14, batch: int = 128, rate: float = 3e-3) -> Model:
        """Fit on windows in memory; ``train`` does the same on a table."""
        y = np.array(labels, np.float32)
        if not 0 < y.sum(initial=0) < len(y):
            return self
        x, rng = self._array(windows), np.random.default_rng(13)
        order = rng.permutation(len(y))
        test, learn = order[: len(y) // 4], order[len(y) // 4 :]
        if any(len(np.unique(y[part])) < 2 for part in (test, learn)):
            # A quarter of either class is kept aside, at least one; the only one of a class is learnt from as well.
            orders = [rng.permutation(np.flatnonzero(y == c)) for c in (0, 1)]
            test = np.concatenate([o[: max(1, len(o) // 4)] for o in orders])
            learn = np.concatenate([o[max(1, len(o) // 4) :] if len(o) > 1 else o for o in orders])
        self.learn(x[learn], y[learn], epochs, rng, batch=batch, rate=rate)
        self._calibrate(self._logits(x[test]).astype(float), y[test], np.ones(len(test)))
        return self

    def learn(
        self, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator, weights: tuple[float, float] = (1.0, 1.0), batch: int = 128, rate: float = 3e-3,
        least: int = LEAST_STEPS,
    ) -> None:
        """Goes through the windows ``epochs`` times; few of them are gone through more often."""
        epochs = max(epochs, -(-least // -(-len(y) // batch)))
        weigh = np.where(y == 1, weights[1], weights[0]).astype(np.float32)
        moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                part, step = order[at : at + batch], step + 1
                z, kept = self._forward(x[part])
                gradient = self._backward((1 / (1 + np.exp(-z)) - y[part]) * weigh[part] / len(part), kept)
                for k, g in gradient.items():
                    moment[k] = 0.9 * moment[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - (rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def numbers(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(float)

    def with_numbers(self, numbers: np.ndarray) -> Model:
        at = 0
        for k, v in self.p.items():
            self.p[k] = numbers[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def _calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling with smoothed targets, then the largest threshold that keeps the recall. ``n``: how many windows have this logit and class."""
        positive, negative = n[y == 1].sum(), n[y == 0].sum()
        target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, r = n * (p * (1 - p) + 1e-9), n * (target - p)
            # A slope near one is preferred, so that findings without an error among them do not drive it off.
            h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, [(r * z).sum() - (a - 1), r.sum()])
            a, b = a + np.clip(step[0], -0.2, 0.2), b + np.clip(step[1], -0.5, 0.5)
        self.slope, self.shift = float(a), float(b)
        found = np.flatnonzero(y == 1)
        found = found[np.argsort(-self._calibrated(z[found]), kind="stable")]
        last = np.searchsorted(np.cumsum(n[found]), np.ceil(RECALL * positive))
        self.threshold = float(self._calibrated(z[found])[min(len(found) - 1, last)])

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[at : at + 256])[0] for at in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def score(self, windows: list[bytes]) -> np.ndarray:
        """Calibrated probabilities."""
        return self._calibrated(self._logits(self._array(windows)).astype(float)) if windows else np.zeros(0)


WINDOWS = pa.schema([("window", pa.binary()), ("label", pa.int32()), ("hash", pa.int64())])


def labelled_windows(docs: DataFrame) -> DataFrame:
    """``window, label, hash`` of all candidates of all documents, equal ones once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("secrets", lambda: None)
        found: set[tuple[bytes, int]] = set()

        def batch() -> pa.RecordBatch:
            rows = [(w, c, xxhash.xxh3_64_intdigest(w) >> 1) for w, c in found]
            found.clear()
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, WINDOWS, strict=True)], schema=WINDOWS)

        for cells in batches:
            for cell in cells["text"]:
                for labelled in training_windows(cell.as_py()):
                    found.add(labelled)
                    if len(found) >= 4 * GROUP:
                        yield batch()
        yield batch()

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(work, from_arrow_schema(WINDOWS))
    return materialise(rows.distinct(), "windows")


def _groups(rows: DataFrame, groups: int) -> DataFrame:
    """``group, n, windows, labels``: a row for each group of windows, written once."""
    schema = pa.schema([("group", pa.int64()), ("n", pa.int64()), ("windows", pa.binary()), ("labels", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("hash", "ascending"), ("window", "ascending"), ("label", "ascending")])
        cells = [b"".join(table["window"].to_pylist()), bytes(table["label"].to_pylist())]
        return pa.table([pa.array(c, f.type) for c, f in zip([table["group"][:1].to_pylist(), [table.num_rows], cells[:1], cells[1:]], schema)], schema=schema)

    placed = rows.withColumn("group", F.floor(F.col("hash") / ASIDE).cast("long") % groups).repartition(groups, "group")
    return materialise(placed.groupBy("group").applyInArrow(pack, from_arrow_schema(schema)), "groups")


def _round(groups: DataFrame, start: np.ndarray, number: int, epochs: int, weights: tuple[float, float], least: int) -> np.ndarray:
    """The mean of what all groups learn from ``start``, weighted by their windows."""
    kind = "part int, group long, n long, numbers array<double>"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = np.frombuffer(row["windows"], np.uint8).reshape(-1, WIDTH), np.frombuffer(row["labels"], np.uint8).astype(np.float32)
                model = Model().with_numbers(start)
                model.learn(x, y, epochs, np.random.default_rng([13, number, row["group"]]), weights, least=least)
                columns = [[row["group"] % BUFFERS], [row["group"]], [row["n"]], [model.numbers() * row["n"]]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["part", "group", "n", "numbers"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("group")
        sums = np.sum([v.values.to_numpy() for v in table["numbers"]], axis=0)
        columns = [table["part"][:1], table["group"][:1], pa.array([sum(table["n"].to_pylist())], pa.int64()), pa.array([sums], pa.list_(pa.float64()))]
        return pa.table(columns, ["part", "group", "n", "numbers"])

    found = groups.mapInArrow(learn, kind).groupBy("part").applyInArrow(add, kind).toArrow().sort_by("part")  # at most BUFFERS rows
    return np.sum([v.values.to_numpy() for v in found["numbers"]], axis=0) / sum(found["n"].to_pylist())


def train(docs: DataFrame) -> Model:
    """Fit on the candidates of all documents, calibrate on all that are kept aside.

    The windows are learnt from in groups, each by one task from the same start; the next round starts from the mean of what the groups have learnt. What reaches the
    driver are sums of the network's numbers, and counts of kept windows by class and logit, in steps of a thousandth.
    """
    rows, model = labelled_windows(docs), Model()
    aside = F.col("hash") % ASIDE == 0
    sizes = {c: [0, 0] for c in (0, 1)}
    for r in rows.groupBy("label", aside.cast("int").alias("aside")).count().collect():
        sizes[r["label"]][r["aside"]] = r["count"]
    if not all(sum(n) for n in sizes.values()):
        return model
    # A class that the hash puts on one side as a whole is both learnt from and judged.
    both = F.col("label").isin([c for c, n in sizes.items() if not all(n)])
    n = [sum(v) if not all(v) else v[0] for v in (sizes[0], sizes[1])]
    weights = tuple(max(1.0, LEAST_SHARE * sum(n) / mine) for mine in n)
    groups = -(-sum(n) // GROUP)
    held = _groups(rows.filter(~aside | both), groups)
    numbers = model.numbers()
    for number in range(ROUNDS if groups > 1 else 1):
        numbers = _round(held, numbers, number, *((1, weights, 0) if groups > 1 else (14, weights, LEAST_STEPS)))
    model.with_numbers(numbers)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model().with_numbers(numbers)
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED):
                part = batch.slice(at, SCORED)
                z = np.clip(fitted._logits(Model._array(part["window"].to_pylist())).astype(float), -MOST_LOGIT, MOST_LOGIT)
                yield pa.record_batch([part["label"], pa.array(np.floor(z * STEPS).astype(np.int32))], ["label", "step"])

    judged = rows.filter(aside | both).select("window", "label").mapInArrow(judge, "label int, step int")
    counts = judged.groupBy("label", "step").count().orderBy("label", "step").toArrow()  # a row for each class and step
    model._calibrate(counts["step"].to_numpy() / STEPS, counts["label"].to_numpy(), counts["count"].to_numpy().astype(float))
    return model


def find(texts: list[str], model: Model) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """For every text the base spans, and all spans: those of the network lie outside the base spans.

    Slices that reach the threshold are marked, overlapping ones as one span.
    """
    base: list[list] = []
    added: list[list] = [[] for _ in texts]
    places: list[tuple[int, int, int]] = []
    windows: list[bytes] = []

    def judge() -> None:
        for (i, a, b), p in zip(places, model.score(windows), strict=True):
            if p >= model.threshold:
                if added[i] and a < added[i][-1][1]:
                    added[i][-1] = (added[i][-1][0], b, "model")
                else:
                    added[i].append((a, b, "model"))
        places.clear()
        windows.clear()

    for i, text in enumerate(texts):
        runs = candidates(text)
        base.append(base_spans(text, runs))
        for part in parts_outside(runs, base[i]) if np.isfinite(model.threshold) else ():
            for a, b in slices(*part):
                places.append((i, a, b))
                windows.append(window(text, a, b))
                if len(windows) == SCORED:
                    judge()
    judge()
    return [(b, sorted(b + more, key=lambda s: (s[0], KINDS.index(s[2])))) for b, more in zip(base, added, strict=True)]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


FINDINGS = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
])
BLOCK = 256


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    Null counts as empty and has no spans. Repeated rows come back as often as they stand there, null ids stay null; other
    columns are not read. Positions are code points.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for at in range(0, batch.num_rows, BLOCK):
            for base, spans in find(batch["text"].slice(at, BLOCK).to_pylist(), held.value):
                kinds = [k for _, _, k in base]
                rows.append((*[kinds.count(k) for k in KINDS[:3]], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.record_batch([batch["doc_id"], *[pa.array(c, f.type) for c, f in zip(columns, list(FINDINGS)[1:], strict=True)]], schema=FINDINGS)

    return via_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), work, FINDINGS)


def redact(docs: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found replaced by ``mark``; ``n_chars``, where it stands, is counted anew for changed texts.

    All rows stay, repeated ones and null ids as well, with all their columns, whatever their names. A null text stays null, an empty one empty.
    An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def clean(texts: pa.Array) -> pa.Array:
        only_cache("secrets", lambda: None)
        out = [pa.array([], pa.string())]
        for at in range(0, len(texts), BLOCK):
            part = texts.slice(at, BLOCK).to_pylist()
            found = find([t or "" for t in part], held.value)
            out.append(pa.array([replaced(t, spans, mark) if spans else t for t, (_, spans) in zip(part, found, strict=True)], pa.string()))
        return pa.concat_arrays(out)

    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    given = docs.select(F.col("text").cast("string").alias("_text"), *[F.col(c).alias(n) for c, n in names.items()])
    # By mapInArrow as the operators around it: a UDF would have Python workers of its own, beside theirs, which keep their memory.
    marked = via_arrow(
        given, lambda batch: pa.RecordBatch.from_arrays([*batch.columns, clean(batch.column(0))], [*batch.schema.names, "_clean"]),
        StructType([*given.schema.fields, StructField("_clean", StringType())]),
    )
    changed = ~F.col("_clean").eqNullSafe(F.col("_text"))
    columns = {c: F.col(names[c]) if c in names else F.col("_clean") for c in docs.columns}
    if "n_chars" in names:
        size = F.length("_clean").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(changed, size).otherwise(F.col(names["n_chars"]))
    return marked.select(*[v.alias(c) for c, v in columns.items()])


def replaced(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
