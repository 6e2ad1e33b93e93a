"""Quality classifier from weak labels: overlapping heuristic labellers, expectation-maximisation of their
accuracies, and a hashed linear scorer trained on the posterior labels.

Each labeller votes good, bad or nothing on a text. Under one hidden class, votes are taken as independent; EM
estimates each labeller's vote rates within either class from the numbers of the vote patterns, of which there are
at most 3**labellers whatever the corpus. The posterior of a pattern is the label of its documents. The scorer is a
logistic regression over hashed character-class trigrams and hashed ratio buckets, fitted on a hash sample of about
TRAIN_ROWS documents (twice that parameter is the bound) and applied to every whole text.

Null and empty texts have no words; all labellers abstain and they get the scorer's prior score, EMPTY_SCORE, and
are rejected. Repeated rows are scored alike. Columns pass through, but for those named as the results; their names can
be chosen. Texts of any length are read whole. Empty tables give empty results; with fewer than two vote patterns
the posterior alone decides nothing and every document with words is kept.
"""

from __future__ import annotations

import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.llm.runtime import lean, materialize, small_batches

TRAIN_ROWS = 4000
DIMS = 1024
KEEP = 0.5
EMPTY_SCORE = 0.0
SYMBOLS = "#$%&*@^~=+<>\\_"
#: (ratio, good up to, bad from) of each labeller; between the two it abstains, and one with no `good up to` only
#: ever votes bad or nothing. A ratio counts per word.
LABELLERS = (
    ("symbols", None, 0.2),
    ("pipes", None, 0.2),
    ("shouts", None, 0.3),
    ("capitals", None, 0.3),
    ("stutter", None, 0.2),
    ("sameness", 0.55, 0.75),
    ("wordless", 0.35, 0.45),
    ("endless", 0.98, 0.995),
)
#: Labellers of ratios that mean little in a few words abstain below so many.
FEW = 40
#: Places of the features that hold ratio buckets and length.
WIDE = 16 * (len(LABELLERS) + 1)
GOOD, BAD, NONE = 1, 2, 0


def ratios(text: str) -> tuple[int, list[float]]:
    """Number of words, and the labellers' ratios in order."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, [0.0] * len(LABELLERS)
    return n, [
        sum(map(text.count, SYMBOLS)) / n,
        text.count("|") / n,
        text.count("!") / n,
        sum(map(str.isupper, words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - sum(map(str.isalpha, words)) / n if n >= FEW else 0.4,
        1 - (text.count(".") + text.count("?") + text.count("!")) / n if n >= 50 else 0.99,
    ]


def pattern(n: int, found: list[float]) -> int:
    """The votes as one number in base 3."""
    code = 0
    for value, (_, good, bad) in zip(found, LABELLERS):
        vote = NONE if not n else GOOD if good is not None and value <= good else BAD if value >= bad else NONE
        code = code * 3 + vote
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


def estimate(counts: dict[int, int], rounds: int = 200):
    """EM over vote patterns: ({pattern: probability of good}, rates[class][labeller][vote], share of good).

    It starts with patterns that hold a bad vote at 0.3 and the others at 0.9, and smooths rates by one vote of
    each kind."""
    import numpy as np

    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], dtype=float)
    votes = np.array([votes_of(c) for c in codes]).reshape(len(codes), len(LABELLERS))
    p = np.where((votes == BAD).any(axis=1), 0.3, 0.9)
    hot = np.stack([votes == v for v in (NONE, GOOD, BAD)], axis=2).astype(float)
    rates, share = None, 0.5
    for _ in range(rounds):
        w = np.stack([n * (1 - p), n * p])
        rates = np.einsum("kc,cjv->kjv", w, hot) + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        share = (w[1].sum() + 1) / (n.sum() + 2)
        # an abstention says nothing of the class
        told = hot.copy()
        told[:, :, NONE] = 0
        log = np.einsum("cjv,kjv->kc", told, np.log(rates)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done = float(np.abs(new - p).max()) < 1e-9
        p = new
        if done:
            break
    return dict(zip(codes, p.tolist())), rates, share


def _tables():
    """The class of each byte, and the place of each class trigram among the hashed features."""
    import numpy as np

    kinds = np.full(256, 1, dtype=np.int64)  # other bytes
    kinds[128:] = 2
    for i, group in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t", ".", ",", "!", "?", "|", "#", "$", "%", "&", "*", "-", "'\"", ":;", "()[]{}", "/\\", "@", "_=+<>^~`")):
        kinds[[ord(c) for c in group]] = 3 + i
    n = int(kinds.max()) + 1
    place = (np.arange(n**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(DIMS - WIDE)
    return kinds, n, place.astype(np.int64)


_cached: list = []


def features(text: str, found: list[float], n_words: int):
    """Hashed features of a text: trigrams of character classes by damped frequency, ratios by bucket, length."""
    import numpy as np

    if not _cached:
        _cached.append(_tables())
    kinds, n, place = _cached[0]
    out = np.zeros(DIMS, dtype=np.float32)
    k = kinds[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    if len(k) > 2:
        seen = np.log1p(np.bincount(place[(k[:-2] * n + k[1:-1]) * n + k[2:]], minlength=DIMS - WIDE))
        norm = float(np.sqrt((seen * seen).sum()))
        out[: DIMS - WIDE] = seen / norm
    for i, value in enumerate(found):
        out[DIMS - WIDE + 16 * i + min(15, int(value * 16))] = 1
    out[DIMS - 16 + min(15, n_words.bit_length())] = 0.5
    return out


def fit(x, y, rounds: int = 400, ridge: float = 1e-4):
    """Logistic regression on soft labels by accelerated gradient descent: weights, the last one the bias."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros(x.shape[1])
    step = 4.0 / max(1e-9, float((x * x).sum(axis=1).max()))
    ahead, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (p - y) / len(x) + ridge * ahead)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS):
    """(weights or None, vote patterns with their posteriors). Every text is voted on; about train_rows of them, by a
    hash of id and text, are what the scorer is fitted on."""
    import numpy as np

    rows = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def vote(batches):
        import pyarrow as pa

        for b in batches:
            codes, words = [], []
            for t in b.column(1).to_pylist():
                n, found = ratios(t)
                codes.append(pattern(n, found))
                words.append(n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.int32()), pa.array(words)], names=["h", "code", "words"])

    counts = materialize(rows.mapInArrow(lean(vote), "h long, code int, words boolean").where("words").groupBy("code").agg(F.count("*").alias("n")))
    patterns = {r.code: r.n for r in counts.collect()}
    if len(patterns) < 2:
        return None, dict.fromkeys(patterns, 1.0)
    posterior, _, _ = estimate(patterns)
    share = min(1.0, train_rows / sum(patterns.values()))
    below = int(share * 2.0**64 - 2.0**63) if share < 1 else 2**63 - 1

    def featured(batches):
        import pyarrow as pa

        for b in batches:
            codes, xs = [], []
            for t in b.column(1).to_pylist():
                n, found = ratios(t)
                if n:
                    codes.append(pattern(n, found))
                    xs.append(features(t, found, n).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(xs, pa.binary())], names=["code", "x"])

    # copies of a row share a hash and come together; the limit holds whatever there are
    sample = rows.where(F.col("h") <= below).mapInArrow(lean(featured), "code int, x binary").limit(2 * train_rows).toLocalIterator()
    codes, xs = [], []
    for r in sample:
        codes.append(r.code)
        xs.append(np.frombuffer(r.x, dtype=np.float32))
    if not xs:
        return None, posterior
    y = np.array([posterior[c] for c in codes])
    return fit(np.array(xs), y), posterior


def score(docs: DataFrame, weights, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, names: tuple[str, str] = ("quality_score", "keep")) -> DataFrame:
    """The rows of docs with a score (double) and whether it is kept (boolean), under `names`; columns of docs that have
    these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rest = [c for c in docs.columns if c not in names]
    rows = docs.select(*rest)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = shared.value
        for b in batches:
            at = b.schema.get_field_index(text_col)
            out = []
            for t in b.column(at).to_pylist():
                n, found = ratios(t or "")
                if not n:
                    out.append(EMPTY_SCORE)
                elif w is None:
                    out.append(1.0)
                else:
                    out.append(float(1 / (1 + np.exp(-np.clip(features(t, found, n) @ w[:-1] + w[-1], -30, 30)))))
            score = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, score, pa.array([s >= keep for s in out])], names=[*b.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lean(run), f"{schema}, `{names[0]}` double, `{names[1]}` boolean")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, keep: float = KEEP, names: tuple[str, str] = ("quality_score", "keep")) -> DataFrame:
    """Every row of docs with its score and whether it is kept."""
    small_batches(docs.sparkSession)
    weights, _ = train(docs, id_col, text_col, train_rows)
    return score(docs, weights, id_col, text_col, keep, names)
