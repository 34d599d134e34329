"""Generated, minified, vendored and data files, told from hand-written source by linear support-vector classifiers.

One classifier for each kind, on hashed character n-grams of the whole text (4 characters by frequency, 8 by presence, and 5 by
the characters' shapes) and hashed path components. The labels for training are weak: banners, line shapes, share of literals,
overlap with known upstream files, folder names. None of these measures is a feature: they are taken of the rows for fitting
alone. What gave a file its generated label, the banner, is masked out of every text, with all top comments, before its n-grams
are taken. Validation splits by repository: the held-out repositories' files are never trained on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["generated", "minified", "copied", "foreign", "data"]
#: Most rows that the classifiers are fitted on; they are drawn evenly by a hash of the id from the whole table.
FIT_ROWS = 6000
#: The blocks of features: short n-grams, long n-grams, n-grams of shapes, folders, parts of the file's name, and a constant.
BITS = {"grams": 15, "longs": 16, "shapes": 15, "folders": 14, "names": 12, "bias": 0}
AT = {k: sum(1 << n for n in list(BITS.values())[:i]) for i, k in enumerate(BITS)}
BIAS = AT["bias"]
SIZE = BIAS + 1
#: The blocks that each kind is told by.
BLOCKS = {"generated": {"grams", "names"}, "minified": {"shapes", "names"}, "copied": {"longs"}, "foreign": {"folders"}, "data": {"shapes"}}
WINDOW_BITS = 22
#: Files whose features are made in one go.
TOGETHER = 64

# Phrases by which tools mark their output, and usual names of folders for foreign code.
BANNER = re.compile(r"@generated|auto-?\s?generated|code generated|generated (?:by|from|file|code)|do not (?:edit|modify|change)|automatically (?:produced|generated|created)|machine[- ](?:written|generated|made)|changes will be lost", re.I)
FOREIGN = set("vendor vendors vendored third_party thirdparty third-party 3rdparty 3rd_party 3rd-party node_modules bower_components jspm_packages godeps _vendor extern external externals deps contrib".split())
_PAYLOAD = re.compile(r"""0x[0-9a-fA-F]+|\b\d[\d.]*\b|b?"[^"\s]{24,}"|'[^'\s]{24,}'|`[^`\s]{24,}`|[A-Za-z0-9+/=]{40,}|(?:\\x[0-9a-fA-F]{2})+""")
_HINTS = ("generat", "do not ", "automatically ", "machine", "changes will be lost")
# The shape of each byte: blank, line end, digit, hexadecimal letter, other letter, separator, quote, anything else.
_SHAPE = np.array([0 if i in b" \t" else 1 if i in b"\r\n" else 2 if i in b"0123456789" else 3 if i in b"abcdefABCDEF" else 4 if chr(i).isalpha() and i < 128 else 5 if i in b",;" else 6 if i in b"\"'`" else 7 for i in range(256)], np.uint32)
_PLAIN = np.array([48 if 48 <= i <= 57 else i for i in range(256)], np.uint32)  # all digits alike


def _parts(path: str | None) -> tuple[list[str], list[str]]:
    """Lower-case folders, and the pieces of the file name with its endings."""
    p = [x for x in re.split(r"[\\/]+", (path or "").lower()) if x not in ("", ".", "..")]
    name = p[-1] if p else ""
    return p[:-1], [*re.split(r"[._\-\d]+", name), *re.findall(r"[._][a-z]\w*(?=\.)", name)]


def _windows(raw: bytes) -> np.ndarray:
    """Hashes of all 24-byte windows."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 24:
        return np.empty(0, np.int64)
    g = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    h = np.zeros(len(g) - 20, np.uint32)
    for k, p in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491)):
        h = (h ^ (g[4 * k : 4 * k + len(h)] * np.uint32(p))) * np.uint32(0x01000193)
    return (h >> np.uint32(32 - WINDOW_BITS)).astype(np.int64)


_TOP = re.compile(r"""\A\ufeff?\s*(?:/\*(?s:.*?)\*/\s*|(?://|\#(?![a-z]))[^\n]*\n\s*|\"\"\"(?s:.*?)\"\"\"\s*)*""")


def _bytes(text: str) -> bytes:
    """The text without its top comments and without banners anywhere."""
    text, low = _TOP.sub("", text), text.lower()
    if any(x in low for x in _HINTS):  # every banner holds one of them
        text = BANNER.sub(" ", text)
    return text.encode("utf-8", "replace")


def index_bitmap(texts: list[str | None]) -> bytes:
    """The windows of known upstream files as a bitmap of fixed size; the table of them does not grow."""
    bits = np.zeros(1 << WINDOW_BITS, bool)
    for t in texts:
        bits[_windows(_bytes(t or ""))] = True
    return np.packbits(bits).tobytes()


def _counted(file: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """File, code and number of occurrences of each distinct code of 16 bits in each file."""
    c = np.sort((file << np.uint32(16)) | codes)
    at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
    c, n = c[at], np.diff(np.append(at, len(c)))
    return (c >> np.uint32(16)).astype(np.int64), (c & np.uint32(0xFFFF)).astype(np.int64), n


def features(paths: list[str | None], texts: list[str | None], blocks: set[str]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """File (its place in the lists), position and value of each feature of the blocks asked for, of at most 65,536 files.

    A null or empty text has its path's features only.
    """
    raw = [_bytes(t) if t else b"" for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8)
    file = np.repeat(np.arange(len(raw), dtype=np.uint32), size)
    out = {}

    def put(name: str, codes: np.ndarray, width: int, frequency: bool) -> None:
        here = np.ones(len(codes), bool)
        for z in np.cumsum(size)[:-1]:  # no gram runs over the end of a file
            here[max(z - width + 1, 0) : z] = False
        f, code, n = _counted(file[: len(codes)][here], codes[here])
        total = np.bincount(f, n if frequency else None, minlength=len(raw))
        out[name] = f.astype(np.int32), (code + AT[name]).astype(np.int32), np.sqrt((n if frequency else 1) / total[f]).astype(np.float32)

    if len(b) >= 8:
        if blocks & {"grams", "longs"}:
            d = _PLAIN[b]
            g = (d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)) * np.uint32(2654435761)
        if "grams" in blocks:
            put("grams", g >> np.uint32(32 - BITS["grams"]), 4, True)
        if "longs" in blocks:
            h = ((g[:-4] ^ g[:-4] >> np.uint32(15)) * np.uint32(0x85EBCA77) + g[4:]) * np.uint32(0xC2B2AE3D)
            put("longs", h >> np.uint32(32 - BITS["longs"]), 8, False)
        if "shapes" in blocks:
            h = _SHAPE[b]
            put("shapes", h[:-4] << np.uint32(12) | h[1:-3] << np.uint32(9) | h[2:-2] << np.uint32(6) | h[3:-1] << np.uint32(3) | h[4:], 5, True)
    parts = [_parts(p) for p in paths]
    for which, name in enumerate(("folders", "names")):
        if name in blocks:
            found = [sorted({AT[name] + zlib.crc32(x.encode()) % (1 << BITS[name]) for x in p[which] if x}) for p in parts]
            n = np.array([len(x) for x in found], np.int64)
            out[name] = np.repeat(np.arange(len(paths)), n), np.array([x for xs in found for x in xs], np.int64), np.repeat(0.5 / np.maximum(n, 1) ** 0.5, n)
    out["bias"] = np.arange(len(paths)), np.full(len(paths), BIAS), np.full(len(paths), 0.5)
    return out


def chunked(paths: list[str | None], texts: list[str | None]) -> list[tuple[int, dict]]:
    """The number of files and the features of all blocks, TOGETHER files at a time."""
    return [(len(paths[a : a + TOGETHER]), features(paths[a : a + TOGETHER], texts[a : a + TOGETHER], set(BITS))) for a in range(0, len(paths), TOGETHER)]


def rows_of(chunks: list[tuple[int, dict]], blocks: set[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and values of each file by itself."""
    out = []
    for n, got in chunks:
        f, p, v = (np.concatenate(x) for x in zip(*(got[k] for k in sorted(blocks & got.keys() | {"bias"}))))
        order = np.argsort(f, kind="stable")
        cuts = np.searchsorted(f[order], np.arange(1, n))
        out += zip(np.split(p[order], cuts), np.split(v[order].astype(float), cuts))
    return out


def measures(path: str | None, text: str | None, index: np.ndarray) -> dict[str, float]:
    """What the weak labels of one file are made from."""
    m = {"payload": 0.0, "long": 0.0, "blank": 0.0, "known": 0.0, "foreign": float(any(f in FOREIGN for f in _parts(path)[0])), "banner": 0.0}
    if text:
        w = _windows(_bytes(text))
        m["known"] = float(index[w].mean()) if len(w) else 0.0
        solid = sum(map(len, text.split())) - text.count(",") or 1
        m["payload"] = sum(map(len, _PAYLOAD.findall(text))) / solid
        m["long"] = sum(n for n in map(len, text.splitlines()) if n > 250) / len(text)
        m["blank"] = 1 - solid / len(text)
        m["banner"] = float(any(BANNER.search(x) and x.lstrip()[:1] in ("/", "#", "*", "-", ";", '"', "'", "<") for x in text.split("\n", 8)[:8]))
    return m


def weak_labels(m: dict[str, float]) -> dict[str, bool]:
    return {
        "generated": m["banner"] > 0,
        "minified": m["long"] > 0.6 and m["blank"] < 0.12 and m["payload"] < 0.4,
        "copied": m["known"] > 0.6,
        "foreign": m["foreign"] > 0,
        "data": m["payload"] > 0.5,
    }


def fit(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, c: float = 4.0) -> np.ndarray:
    """A linear support-vector machine with squared hinge loss, by dual coordinate descent; the rarer side weighs more.

    Rows that are well beyond the margin are passed over, but for every third round, which sees them all.
    """
    w, n = np.zeros(SIZE), len(xs)
    n_pos = int((y > 0).sum())
    if not n_pos or n_pos == n:
        w[BIAS] = 1e3 if n_pos else -1e3
        return w
    weight = np.where(y > 0, min(20.0, max(1.0, (n - n_pos) / n_pos)), 1.0)
    diag = 1 / (2 * c * weight)
    q = np.array([v @ v for _, v in xs]) + diag
    a, rng, idle = np.zeros(n), np.random.default_rng(7), np.zeros(n, bool)
    for epoch in range(epochs):
        todo = np.arange(n) if epoch % 3 == 0 else np.flatnonzero(~idle)
        for i in rng.permutation(todo):
            p, v = xs[i]
            grad = y[i] * (w[p] @ v) - 1 + a[i] * diag[i]
            new = max(0.0, a[i] - grad / q[i])
            idle[i] = new == 0 and grad > 0.1
            if new != a[i]:
                w[p] += (new - a[i]) * y[i] * v
                a[i] = new
    return w


def _held_out(repo: str | None) -> bool:
    return zlib.crc32((repo or "").encode()) % 5 == 0


def _train(index_texts: list[str | None]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = np.unpackbits(np.frombuffer(index_bitmap(index_texts), np.uint8)).astype(bool)
        b = pd.concat(list(batches) or [pd.DataFrame(columns=["request_id", "repo", "file_path", "snippet"])]).drop_duplicates("request_id").sort_values("request_id")
        paths, texts = b["file_path"].tolist(), b["snippet"].tolist()
        labels = [weak_labels(measures(p, t, index)) for p, t in zip(b["file_path"], b["snippet"])]
        held = np.array([_held_out(r) for r in b["repo"]], bool)
        use = np.flatnonzero(~held)
        # known upstream files and bare folder names stand for their kinds beside the rows
        names = sorted(FOREIGN)
        every = chunked(paths, texts)
        more = {"copied": chunked([None] * len(index_texts), index_texts), "foreign": chunked([f"{x}/_" for x in names], [None] * len(names))}
        weights, out = [], []
        for kind in KINDS:
            y = np.array([1.0 if x[kind] else -1.0 for x in labels])
            rows, extra, target = rows_of(every, BLOCKS[kind]), rows_of(more.get(kind, []), BLOCKS[kind]), y
            if kind == "generated" and len(use):
                # Files that lost their banner read like those that have it: a first fit on n-grams alone, loose enough not
                # to learn single files, finds them among the rest, and they join the positives.
                grams = rows_of(every, {"grams"})
                w = fit([grams[i] for i in use], y[use], epochs=6, c=0.1)
                target = np.where(np.array([w[p] @ v for p, v in grams]) > 0, 1.0, y)
            w = fit([*(rows[i] for i in use), *extra], np.r_[target[use], np.ones(len(extra))]) if len(use) else np.zeros(SIZE)
            weights.append(w)
            flagged = np.array([w[p] @ v for p, v in rows]) > 0 if rows else np.empty(0, bool)
            said = pd.DataFrame({"repo": b["repo"].to_numpy(), "held": held, "t": y > 0, "f": flagged, "both": (y > 0) & flagged})
            for (repo, h), x in said.groupby(["repo", "held"], dropna=False):
                out.append((kind, None if pd.isna(repo) else repo, bool(h), len(x), int(x["t"].sum()), int(x["f"].sum()), int(x["both"].sum()), None))
        yield pd.DataFrame([("model", "", False, 0, 0, 0, 0, np.stack(weights).astype(np.float32).tobytes()), *out], columns=["kind", "repo", "held_out", "files", "labelled", "flagged", "both", "weights"])

    return run


VALIDATION = "kind string, repo string, held_out boolean, files int, labelled int, flagged int, both int"


def train(requests: DataFrame, index_texts: list[str | None], fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, list[tuple]]:
    """(weights, VALIDATION rows): fitted in one task on at most about `fit_rows` rows; only the weights and a row for each
    kind and repository of these rows reach the driver."""
    n = requests.count()
    part = requests if n <= fit_rows else requests.where(F.pmod(F.xxhash64("request_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    got = part.select("request_id", "repo", "file_path", "snippet").coalesce(1).mapInPandas(_train(index_texts), f"{VALIDATION}, weights binary").collect()
    weights = next((np.frombuffer(bytes(r.weights), np.float32).reshape(len(KINDS), SIZE) for r in got if r.kind == "model"), np.zeros((len(KINDS), SIZE), np.float32))
    return weights, [tuple(r)[:-1] for r in got if r.kind != "model"]


def _score(weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), len(KINDS)))
            at = 0
            for n, got in chunked(b["file_path"].tolist(), b["snippet"].tolist()):
                for i, kind in enumerate(KINDS):
                    for name in BLOCKS[kind] & got.keys() | {"bias"}:
                        f, p, v = got[name]
                        out[at : at + n, i] += np.bincount(f, weights[i][p] * v, minlength=n)
                at += n
            yield pd.DataFrame({"request_id": b["request_id"], **{k: out[:, i] for i, k in enumerate(KINDS)}})

    return run


def _inputs(requests: DataFrame, vendored: DataFrame) -> tuple[DataFrame, list[str | None]]:
    texts = [r.text for r in vendored.select("text").collect()]  # a fixed table of known upstream files
    return requests.where("request_id is not null").select("request_id", "repo", "file_path", "snippet"), texts


def scores(requests: DataFrame, vendored: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """request_id and a score for each kind, positive where the classifier says so; each distinct request once.

    Null ids have no row; a null path or text leaves the other's features. An empty table has no scores.
    """
    rows, texts = _inputs(requests, vendored)
    weights, _ = train(rows, texts, fit_rows)
    shape = "request_id bigint, " + ", ".join(f"{k} double" for k in KINDS)
    return rows.select("request_id", "file_path", "snippet").mapInPandas(_score(weights), shape).distinct()


def validation(requests: DataFrame, vendored: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """VALIDATION: for each kind and repository the files of the fitting rows, how many of them are labelled, flagged, and both.

    Files of a held-out repository were not trained on. `fit_rows` bounds the rows, and so the result.
    """
    rows, texts = _inputs(requests, vendored)
    return requests.sparkSession.createDataFrame(train(rows, texts, fit_rows)[1], VALIDATION)


def foreign_files(requests: DataFrame, vendored: DataFrame) -> DataFrame:
    """request_id of each request that some classifier takes for not written by hand."""
    return scores(requests, vendored).where(" or ".join(f"{k} > 0" for k in KINDS)).select("request_id").distinct()
