"""Problem 6: credentials in code, found by a logistic regression and masked.

Candidates are all quoted literals and assigned values after telling names, all passwords of addresses, and elsewhere tokens of the
code with a digit, a mixed case or a special character, stripped of what is around the bare value: name
and equals sign, option letters, scheme and user name of an address, quotes and tags. Private key blocks are candidates from their
BEGIN to their END line.

The model. Weak labels come from patterns: known token formats and values after telling names are positive; digests, commits,
placeholders, images and plain code are negative; the rest is unlabelled. From the labelled candidates of a bounded sample
(SAMPLE_ROWS rows, chosen by a hash of seq) two character Markov chains are fitted (secrets, other code) and a logistic regression on the
difference of their likelihoods, the shape of the value, the identifiers before it, and the path; the patterns that label are no
features. Scores are calibrated by isotonic regression on every fifth labelled candidate, held out from the fit: a value is reported
from a calibrated probability of LEAST. Training is the only step on a sample; every row is scored, without shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample, in rows of findings with code.
SAMPLE_ROWS = 8_000
#: Weight of the squared coefficients in the fit.
RIDGE = 0.1
#: Least calibrated probability of a value that is reported and masked.
LEAST = 0.5
#: Bound of the labelled candidates that the regression is fitted on.
TRAIN_CANDIDATES = 20_000
FIELDS = ("code_snippet", "remediation_code")
MASK = "REDACTED"
_HASHED = 512
_LEFT = 60

_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]*?)(PRIVATE|PUBLIC) KEY( BLOCK)?-----.*?-----END \1\2 KEY( BLOCK)?-----|-----BEGIN [A-Z ]*CERTIFICATE-----.*?-----END [A-Z ]*CERTIFICATE-----", re.DOTALL)
_TOKEN = re.compile(r"""[^\s"'`<>(){}\[\],;|]{6,}""")
_PLAIN = re.compile(r"[A-Za-z_.:/=$@&*?!\\^%#~+-]*")
_BARE = re.compile(r"[A-Z]?[a-z]+|[A-Z_]+|[a-z_.:/=$@&*?!\\^-]+")
_ASSIGNED = re.compile(r"(-{0,2}[A-Za-z_][\w.-]*)(?:=(?!=)|:(?!/|:))(?=[^=\s])")
_ADDRESS = re.compile(r"[A-Za-z][\w+.-]*://([^:/@\s]*)(?::(.+))?@[^@/\s]")
_OPTION = re.compile(r"-[pP](?=.{4})")

_QUOTED = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\r\n])+)\1""")
_BOUND = re.compile(r"""(?<![=!<>])[=:][ \t]*(?![=:/])([^\s"'`<>(){}\[\],;|]+)(?=[\s,;|]|$)""")
_PARAMETER = re.compile(r"""[?&;]([A-Za-z_][\w.-]*)=([^\s&;#"'`<>]+)""")
_HINT = re.compile(r"pass|pwd|secret|token|key|auth|credential|identified|basic|bearer", re.IGNORECASE)

# Formats of well-known tokens.
_FORMATS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|sk_(?:live|test)_\w{16,}|gh[opsur]_\w{20,}|xox[abpsr]-[\w-]{20,}|AIza[\w-]{30,}|eyJ[\w-]+\.[\w-]+\.[\w-]+|glpat-[\w-]{20,}|npm_\w{30,}")
# Names that announce a secret, and names that announce something else.
_TELLING = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|credential|identified by|basic|bearer|(?<=_)key|sshpass -p|mysql\b.* -)\W{0,6}$|(?:SECRET|TOKEN|KEY|PASSWORD|PASSWD)\w*['\"]?\)?\s*(?:,|\|\||\?:|:-)\s*['\"]?$|password[\"'] value=[\"']$", re.IGNORECASE)
_OTHER = re.compile(r"(?:commit|revision|sha\d*|sha\d+-|md5|digest|checksum|integrity|hash|etag|request_id|trace_id|correlation_id|uuid|guid|icon|image|img|logo|base64|label|title|_url|_uri|_file|_path|_name|NAME|length|version|import|from|href|src)\W{0,6}$", re.IGNORECASE)
_PLACEHOLDER = re.compile(r"x{4,}|\*{3,}|\.{3,}|change.?me|your[-_ ]|example|placeholder|redacted|dummy|<|\$\{|\{\{|vault\.|^\$|^%\w+%$|^(.)\1+$", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_CODE = re.compile(r"[a-z_.:/\d-]+|[\w.]+\(.*|[\d.:/-]+|[A-Z][A-Z0-9_]*|https?://\S*|/\S*|\w+\.\w+(?:\.\w+)*|[a-z]+(?:[A-Z][a-z]+)+\d*")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|==+|\|\||\?:|[=:,/@#*-]")


# A telling name that is a look-up by name.
_LOOKUP = re.compile(r"(?:get|fetch|read|load|lookup)\w*\(\W{0,3}$", re.IGNORECASE)
#: Fixed examples (value, left, kind, label) of what may be rare in a sample: plain words and rare signs in passwords, and names of the code in their place.
_KNOWN = [
    *((v, f"{n}{sign}{q}", "token", 1) for v in ("sunshine", "dragonfly", "Mountain", "letmein", "open-the-gate", "abc") for n, sign in (("password", " = "), ("db_password", " = "), ("secret", ": "), ("PASSWORD", "=")) for q in "'\""),
    *((v, f"postgres://{u}:", "address", 1) for v in ("sunshine", "dragon", "letmein", "abc") for u in ("app", "root", "svc")),
    *((v, left, kind, 1) for c in "~*#%+!^$&" for v in (f"stone_river{c}42", f"mEadow{c}", f"lake97{c}", f"QxvTrpLmw{c}") for left, kind in (("DATABASE_URL=mysql://svc_x:", "address"), ("amqp://y:", "address"), ("X_PASSWD=", "token"), ("x_password = '", "token"))),
    *((v, f"{n}{sign}", "token", 0) for v in ("password", "user.password", "str", "None", "token", "config.secret", "true", "required", "value") for n in ("password", "token", "secret") for sign in (" = ", ": ")),
]


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, what stands before on the line, kind) of each candidate; kind: block, public, address or token."""
    out, blocks = [], []
    if "-----BEGIN" in text:
        for m in _BLOCK.finditer(text):
            blocks.append(m.span())
            out.append((*m.span(), "", "block" if m[2] == "PRIVATE" else "public"))
    named = _named(text) if _HINT.search(text) else []
    for m in _TOKEN.finditer(text):
        token = m.group()
        if not _ADDRESS.search(token) and _PLAIN.fullmatch(token) and (_BARE.fullmatch(token) or not re.search(r"[a-z]{1,3}[A-Z][^a-z]|[A-Z][a-z]+[A-Z]|[!%#~*+^]", token)):
            continue
        start, end = m.span()
        if any(a <= start < b for a, b in blocks):
            continue
        kind = "token"
        if (a := _ASSIGNED.match(text, start, end)) and a.end() < end:
            start = a.end()
        if (a := _ADDRESS.match(text, start, end)):
            group = 2 if a[2] else 1
            if not a[group]:
                continue
            start, end, kind = *a.span(group), "address"
        elif "://" in text[start:end]:
            continue
        elif (a := _OPTION.match(text, start, end)) and re.search(r"\b(?:mysql|mariadb|psql|mongo|sshpass|redis-cli)\w*\b", text[text.rfind("\n", 0, start) + 1 : start]):
            start = a.end()
        while end > start and text[end - 1] in ".:":
            end -= 1
        if end - start >= 6 or kind == "address" and end > start:
            line = text.rfind("\n", 0, start) + 1
            out.append((start, end, text[max(line, start - _LEFT) : start], kind))
    # A literal after a telling name counts as a whole; one with a scheme, an address or names of its own only if nothing is found inside.
    for start, end in named:
        if any(a < end and start < b for a, b in blocks):
            continue
        inner = [c for c in out if c[0] < end and start < c[1]]
        if not inner or (start, end) not in {c[:2] for c in inner} and not re.search(r"^(?i:basic|bearer|token)\s|://|[A-Za-z_]\w*[=:]\S", text[start:end]):
            out = [c for c in out if c not in inner]
            out.append((start, end, text[max(text.rfind("\n", 0, start) + 1, start - _LEFT) : start], "token"))
    for start, end in _parameters(text) if "://" in text else ():
        out = [c for c in out if not (c[0] < end and start < c[1])]
        out.append((start, end, text[max(text.rfind("\n", 0, start) + 1, start - _LEFT) : start], "token"))
    return sorted(out)


def _named(text: str) -> list[tuple[int, int]]:
    """Quoted literals, and bare values after = or :, that stand after a telling name, of any letters and length."""
    spans: list[tuple[int, int]] = []
    for pattern, group in ((_QUOTED, 2), (_BOUND, 1)):
        for m in pattern.finditer(text):
            start, end = m.span(group)
            left = text[max(text.rfind("\n", 0, start) + 1, start - _LEFT) : start]
            if _TELLING.search(left) and not any(a < end and start < b for a, b in spans):
                spans.append((start, end))
    return spans


def _parameters(text: str) -> list[tuple[int, int]]:
    """Values of telling parameters of addresses."""
    out = []
    for m in _PARAMETER.finditer(text):
        before = text.rfind("://", 0, m.start())
        if _TELLING.search(m[1] + "=") and before >= 0 and not re.search(r"\s", text[before : m.start()]):
            out.append(m.span(2))
    return out


def weak_label(value: str, left: str, kind: str) -> int | None:
    """1: a pattern says secret; 0: a pattern says other; None: no pattern speaks."""
    if kind in ("block", "public"):
        return int(kind == "block")
    if _PLACEHOLDER.search(value) or _UUID.fullmatch(value):
        return 0
    if _FORMATS.fullmatch(value):
        return 1
    if kind != "address" and _OTHER.search(left):
        return 0
    telling = bool(_TELLING.search(left))
    if kind == "address":
        plain = len(value) <= 5 or value.isalpha()
        # A plain word is a user name if it stands alone; after a user name it may be a password.
        return 1 if not plain else 0 if left.endswith("//") else None
    if _LOOKUP.search(left) or _bare_name(value, left):
        return 0
    if telling and re.search(r"\d|[^\w]", value) and not re.fullmatch(r"[\w.]+\.\w+|[a-z/_-]+|\d+", value):
        return 1
    if not telling and _CODE.fullmatch(value):
        return 0
    return None


def _longest(pattern: str, value: str) -> int:
    return max(map(len, re.findall(pattern, value)), default=0)


def _dense(value: str, kind: str, path: str | None) -> list[float]:
    """Shape of the value and place; nothing here asks one of the patterns that label."""
    n = len(value)
    digits = sum(c.isdigit() for c in value)
    upper, lower = sum(c.isupper() for c in value), sum(c.islower() for c in value)
    special = n - digits - upper - lower
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    turns = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(value, value[1:]))
    pieces = re.split(r"[-_.:/]", value)
    place = (path or "").lower()
    return [
        1.0, min(n, 80) / 40, float(n < 8), digits / n, upper / n, lower / n, special / n, entropy / 4, max(counts) / n, turns / n, float(bool(upper and lower and digits)), float(not digits),
        float(value.lower().strip("0123456789abcdef") == ""), float(n in (32, 40, 64) and value.strip("0123456789abcdef") == ""), float(len(pieces) == 5 and [len(x) for x in pieces] == [8, 4, 4, 4, 12]), min(len(pieces), 8) / 4,
        min(_longest("[a-z]+", value), 16) / 8, min(_longest("[A-Za-z0-9]+", value), 60) / 30, float("_" in value), float("." in value), float("/" in value), float("(" in value), float(value[:1] in "<$%{*"), float(value[-1:] in ">}*"), float(" " in value),
        float(value[-1:] == "="), float(value[-1:] in "!#%*~+$^"), float(kind == "address"), float(kind == "block"), float(kind == "public"), float("test" in place), float("lock" in place), float(place.endswith((".yaml", ".yml", ".env", ".ini", ".tf"))),
    ]


_DENSE = 33 + 2 + 3


def _bare_name(value: str, left: str) -> bool:
    """Whether the value reads as a name of the code: unquoted, without digits, after a sign and a blank."""
    return bool(re.search(r"[=:][ \t]+$", left) and re.fullmatch(r"[A-Za-z_]+(?:\.[A-Za-z_]+)*", value))


def _names(left: str) -> list[int]:
    from zlib import crc32

    words = [w.lower() for w in _NAMES.findall(left)][-8:]
    near = words[-4:]
    return sorted({crc32(w.encode()) % (_HASHED // 2) for w in words} | {_HASHED // 2 + crc32(("|" + w).encode()) % (_HASHED // 2) for w in near[-2:]})


class Markov:
    """Log-likelihood ratio of two character chains."""

    def __init__(self) -> None:
        self.ratio = np.zeros((97, 97))

    @staticmethod
    def codes(value: str) -> np.ndarray:
        b = np.frombuffer(value.encode("ascii", "replace"), np.uint8).astype(np.int64) - 31
        return np.concatenate([[0], np.where((b > 0) & (b < 97), b, 96)])

    def fit(self, secrets: list[str], others: list[str]) -> Markov:
        logs = []
        for values in (secrets, others):
            counts = np.full((97, 97), 0.3)
            for v in values:
                c = self.codes(v)
                np.add.at(counts, (c[:-1], c[1:]), 1)
            logs.append(np.log(counts / counts.sum(1, keepdims=True)))
        self.ratio = logs[0] - logs[1]
        return self

    def features(self, value: str) -> list[float]:
        c = self.codes(value)
        r = self.ratio[c[:-1], c[1:]]
        return [float(np.clip(r.mean(), -4, 4)), float(np.clip(r.sum() / 20, -4, 4))]


class SecretModel:
    """Scores candidates."""

    def __init__(self) -> None:
        self.chains = Markov()
        self.dense, self.hashed = np.zeros(_DENSE), np.zeros(_HASHED)
        self.threshold = 0.5
        self.steps = (np.array([0.0]), np.array([0.5]))

    def calibrated(self, score: float) -> float:
        """The share of secrets among held-out candidates of such a score."""
        return float(self.steps[1][max(0, int(np.searchsorted(self.steps[0], score, "right")) - 1)])

    def _row(self, value: str, left: str, kind: str, path: str | None) -> tuple[list[float], list[int]]:
        return _dense(value, kind, path) + self.chains.features(value) + [float(left[-1:] in ("'", '"', "`")), float(_bare_name(value, left)), float(kind == "address" and left[-1:] == ":")], [] if kind == "address" else _names(left)

    def score(self, value: str, left: str, kind: str, path: str | None) -> float:
        dense, hashed = self._row(value, left, kind, path)
        z = float(np.dot(self.dense, dense) + sum(self.hashed[hashed]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def fit(self, rows: list[tuple[str, str, str, str | None, int]]) -> SecretModel:
        """rows: value, left, kind, path, label. Every fifth is held out for the threshold."""
        rows = rows[:TRAIN_CANDIDATES]
        if len({r[4] for r in rows}) < 2:
            # Without examples of both kinds only key blocks and passwords of addresses are told from the rest.
            self.dense[[0, 27, 28]] = -3.0, 6.0, 6.0
            return self
        self.chains.fit([r[0] for r in rows if r[4] and r[2] != "block"], [r[0] for r in rows if not r[4]])
        x = np.zeros((len(rows), _DENSE + _HASHED), np.float32)
        for i, (value, left, kind, path, _) in enumerate(rows):
            dense, hashed = self._row(value, left, kind, path)
            x[i, :_DENSE] = dense
            x[i, [_DENSE + h for h in hashed]] = 1
        y = np.array([r[4] for r in rows], np.float32)
        held = np.arange(len(rows)) % 5 == 4
        a, b = x[~held], y[~held]
        w = np.zeros(x.shape[1])
        for _ in range(12):
            # Newton steps; the ridge keeps names that were met on one side only from growing without end.
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope = a.T @ (p - b) + RIDGE * w
            bend = (a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w))
            move = np.linalg.solve(bend, slope)
            w -= move
            if np.abs(move).max() < 1e-4:
                break
        self.dense, self.hashed = w[:_DENSE].astype(float), w[_DENSE:].astype(float)
        p = 1 / (1 + np.exp(-np.clip(x[held] @ w, -30, 30)))
        self.steps = _isotonic(p, y[held])
        likely = self.steps[1] >= LEAST
        if likely.any():
            first = int(np.argmax(likely))
            # Between the last score that is unlikely and the first that is likely, in the middle of their orders of magnitude: a missed secret costs more.
            below = p[p < self.steps[0][first]]
            self.threshold = math.sqrt(float(self.steps[0][first]) * max(1e-6, float(below.max()) if len(below) else 0.0))
        return self


def _isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First score and share of each step of the rising function nearest to the labels y over the scores p: neighbours that fall are pooled."""
    order = np.argsort(p, kind="stable")
    steps: list[list[float]] = []
    for score, label in zip(p[order].tolist(), y[order].tolist()):
        steps.append([score, label, 1.0])
        while len(steps) > 1 and (steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2] or steps[-2][0] == steps[-1][0]):
            _, total, n = steps.pop()
            steps[-1][1] += total
            steps[-1][2] += n
    return np.array([s for s, _, _ in steps] or [0.0]), np.array([t / n for _, t, n in steps] or [0.5])


def train(findings: DataFrame, rows: int = SAMPLE_ROWS) -> SecretModel:
    """A model from a sample of at most `rows` rows with code, the ones whose seq has the smallest hashes."""
    coded = findings.where(" or ".join(f"length({f}) > 0" for f in FIELDS))
    # A share of about twice the bound is taken first, by the row count in the file footers: else every task would send `rows` rows.
    share = max(1, findings.count() // (2 * rows))
    some = coded.where(F.pmod(F.xxhash64("seq"), F.lit(share)) == 0)
    picked = some.select("file_path", *FIELDS, F.xxhash64("seq", F.lit(1)).alias("h")).orderBy("h").limit(rows).toPandas()
    examples = []
    for path, *texts in zip(picked["file_path"], *[picked[f] for f in FIELDS]):
        for text in texts:
            if isinstance(text, str):
                for start, end, left, kind in candidates(text):
                    label = weak_label(text[start:end], left, kind)
                    if label is not None:
                        examples.append((text[start:end], left, kind, path, label))
    if examples:
        examples = [*((v, left, kind, None, label) for v, left, kind, label in _KNOWN), *examples]
    return SecretModel().fit(examples)


def _spans(model: SecretModel, text: str, path: str | None) -> list[tuple[int, int]]:
    return [(s, e) for s, e, left, kind in candidates(text) if model.score(text[s:e], left, kind, path) >= model.threshold]


def found_secrets(findings: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """seq, field_name, secret_text of each distinct literal secret in a code field of findings.

    Null and empty fields hold none; a null path is no path; repeated rows of one seq give one row for each of their secrets.
    """
    learned = model or train(findings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, rows, names, texts = b.column(1).to_pylist(), [], [], []
            for k, field in enumerate(FIELDS):
                for i, text in enumerate(b.column(2 + k).to_pylist()):
                    if text:
                        got = sorted({text[s:e] for s, e in _spans(learned, text, paths[i])})
                        rows += [i] * len(got)
                        names += [field] * len(got)
                        texts += got
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["seq", "field_name", "secret_text"])

    given = findings.where(" or ".join(f"length({f}) > 0" for f in FIELDS)).select("seq", "file_path", *FIELDS)
    return given.mapInArrow(run, "seq long, field_name string, secret_text string")


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with MASK in place of each span; line breaks inside a span stay, so that line numbers hold."""
    for s, e in sorted(spans, reverse=True):
        text = text[:s] + re.sub(r"[^\r\n]+", MASK, text[s:e]) + text[e:]
    return text


def redacted(findings: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """seq and the code fields with the secrets masked; everything else, null fields included, is unchanged. One row for each row."""
    learned = model or train(findings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(1).to_pylist()
            columns = [[masked(t, _spans(learned, t, p)) if t else t for t, p in zip(b.column(2 + k).to_pylist(), paths)] for k in range(len(FIELDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in columns]], names=["seq", *FIELDS])

    return findings.select("seq", "file_path", *FIELDS).mapInArrow(run, "seq long, " + ", ".join(f"{f} string" for f in FIELDS))


