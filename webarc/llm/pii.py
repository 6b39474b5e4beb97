"""Personal data by weak supervision (operator 3).

Candidate spans are found by broad patterns. Five labelers vote on each (+ personal, - not, 0 no opinion): a strict
regex, a gazetteer (address endings, dialling and country codes, issuer prefixes, reserved networks, key prefixes), the words before,
a checksum or range, and the characters at the span's edges. The corpus is then summed up as counts of vote patterns, so that
expectation-maximisation over all candidates runs on a table whose size doesn't depend on the corpus. The
reliabilities that it estimates give each pattern a probability, and these train the final classifier, a
logistic regression on votes and on what the labelers don't see, which decides over every span.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, slices

KINDS = ("email", "phone", "ip", "card", "secret", "iban", "national_id")
LABELERS = ("pattern", "gazetteer", "context", "checksum", "edges")
FLAG_AT = 0.5
#: How strongly the labelers' assumed quality counts against the corpus, as a share of a kind's candidates.
PRIOR = 0.25
ITERATIONS = 60

_DIGITS = re.compile(r"[+(]{0,2}\d(?:[ .\-()/]{0,2}\d){6,}")
#: Phone numbers: fixed layouts, a dialling code or trunk zero with any groups, and groups that may be one.
_LAYOUT = re.compile(r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-/])\d{3,4}[ .\-]?\d{3,4}|\+\d{8,14}|(?:0|\+\d\d[ .\-]?(?:\(0\)[ .\-]?)?)[1-9](?:[ .\-]\d\d){4}")
_DIALLED = re.compile(r"\+(?!1\D)\d{1,3}(?:[ .\-/]?\(\d{1,5}\)[ .\-/]?|[ .\-/])\d{1,8}(?:[ .\-/]\d{1,8}){0,5}|(?:\(0\d{1,4}\)[ \-/]?|0\d{2,4}[ \-/])\d{3,8}(?:[ \-]\d{2,5}){0,2}")
_GROUPS = re.compile(r"\+?\(?\d{1,5}\)?(?:[ .\-/]?\(?\d{2,5}\)?)+")
_LOCAL = re.compile(r"[\w.+\-%]+\Z")
_DOMAIN = re.compile(r"[\w\-]+(?:\.[\w\-]+)*")
_ASSIGNED = re.compile(r"""[=:][ \t]{0,2}["']?([A-Za-z0-9_\-+/.~]{12,})""")
_KEY = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9\-_]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{30,}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")

_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "phone": re.compile(f"{_LAYOUT.pattern}|{_DIALLED.pattern}"),
    "ip": re.compile(r"(?:\d{1,3}\.){3}\d{1,3}"),
    "card": re.compile(r"\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|3\d{3}([ \-]?)\d{6}\2\d{5}|\d{13,19}"),
    "secret": re.compile(r"[A-Za-z0-9_\-+/.~]{16,}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"),
    "national_id": re.compile(r"\d{3}-\d{2}-\d{4}"),
}
_ENDINGS = set(
    "com org net edu gov mil int info biz io co ai app dev me tv name pro museum de fr es it uk us ca au at ch nl be pl pt se no fi dk cz sk hu ro bg gr ie ru ua tr br mx ar cl pe jp cn kr in id vn th sg hk tw nz za ng ke eg il sa ae ir eu example test invalid local".split()
)
_DIALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98", "351", "352", "353", "354", "358", "420", "421"}
_IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "AT": 20, "CH": 21, "NL": 18, "BE": 16, "PL": 28, "PT": 25, "GB": 22, "IE": 22, "SE": 24, "NO": 15, "FI": 18, "DK": 18, "CZ": 24, "LU": 20, "GR": 27, "HU": 28, "RO": 24}
_CUES = {
    "email": "email e-mail mail mailto contact write correo courriel kontakt contacto",
    "phone": "phone tel telephone call mobile cell fax telefon tél téléphone teléfono handy appelez llame anrufen whatsapp",
    "ip": "ip address host server client from adresse dirección",
    "card": "card credit visa mastercard amex kreditkarte carte tarjeta payment pay",
    "secret": "token secret key password passwd pwd apikey api_key api-key access credential bearer auth authorization passwort clave contraseña",
    "iban": "iban account konto compte cuenta bank",
    "national_id": "ssn social security id nss",
}
_CUES = {k: set(v.split()) for k, v in _CUES.items()}
_AGAINST = set("version v ver release build isbn issn doi order invoice article section chapter page figure serial sku model sha sha1 sha256 md5 commit revision checksum".split())
_WORD = re.compile(r"[^\W\d_]+(?:[_\-][^\W\d_]+)*")


def luhn(digits: str) -> bool:
    double = "0246813579"
    return sum(int(c if i % 2 == 0 else double[int(c)]) for i, c in enumerate(reversed(digits))) % 10 == 0


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _shape(s: str, digits: str, open_start: bool, open_stop: bool) -> tuple[int, str] | None:
    """(weight a digit, kind) of groups of digits that make a number: 6 for a fixed layout, 4 for a dialling code with any groups, 2 for groups that may be one.

    open_start and open_stop tell whether a blank, slash or bracket parts them from what stands before and behind.
    """
    n = len(digits)
    if 13 <= n and (n in (15, 16) or luhn(digits)) and _STRICT["card"].fullmatch(s) and ((open_start and open_stop) or luhn(digits)):
        return 6, "card"
    if not (open_start and open_stop):
        return None
    if _STRICT["ip"].fullmatch(s):
        return 6, "ip"
    if _STRICT["national_id"].fullmatch(s):
        return 6, "national_id"
    if 7 <= n <= 15 and s[0] in "+(0" and (fixed := _LAYOUT.fullmatch(s) or _DIALLED.fullmatch(s)):
        return 6 if fixed.re is _LAYOUT else 4, "phone"
    if " " not in s and (kind := _number_kind(s)):
        return 2, kind
    return (2, "phone") if 7 <= n <= 15 and (_GROUPS.fullmatch(s) or _LAYOUT.fullmatch(s)) else None


def _numbers(run: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the numbers in a run of digits and marks: the parting of its groups into numbers that explains most digits, by fewest numbers, the leftmost longest first."""
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    n = len(groups)
    if n == 1:
        kind = _number_kind(run)
        return [(0, len(run), kind)] if kind else []
    marks = [run[x[1] : y[0]] for x, y in zip(groups, groups[1:], strict=False)]
    # A dot or hyphen ties groups together, as in versions and ISBNs; only a whole card's checksum parts them at a hyphen.
    apart = [2, *(2 if any(c in " /()" for c in m) else 0 if "." in m else 1 for m in marks), 2]
    starts = [0, *(y[0] - (run[y[0] - 1] == "(") for y in groups[1:])]
    best: list[tuple[int, int, str]] = [(0, n, "")] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = (best[i + 1][0] - (30 if run[starts[i]] == "+" else 0), i + 1, "")  # a dialling code isn't left behind
        j, digits = i, ""
        while j < n and len(digits) <= 19:
            digits += run[slice(*groups[j])]
            j += 1
            if j - i > 9 and " " in run[starts[i] : groups[j - 1][0]]:  # no shape has so many groups
                break
            if len(digits) >= 4 and apart[i] and apart[j] and (found := _shape(run[starts[i] : groups[j - 1][1]], digits, apart[i] == 2, apart[j] == 2)):
                value = best[j][0] + found[0] * len(digits) - 1
                if value >= best[i][0]:
                    best[i] = (value, j, found[1])
    out, i = [], 0
    while i < n:
        _, j, kind = best[i]
        if kind:
            out.append((starts[i], groups[j - 1][1], kind))
        i = j
    return out


def _number_kind(s: str) -> str | None:
    digits = re.sub(r"\D", "", s)
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", s):
        return "ip"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", s):
        return "national_id"
    if 13 <= len(digits) <= 19 and "." not in s and "(" not in s and s[0] != "+":
        return "card"
    return "phone" if 7 <= len(digits) <= 15 else None


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of spans that may be personal data, by place, none within another; of overlapping ones the longer stays."""
    out = []
    at = text.find("@")
    while at >= 0:
        head = _LOCAL.search(text, max(0, at - 64), at)
        tail = _DOMAIN.match(text, at + 1)
        if head and tail and "." in tail.group():
            out.append((head.start(), tail.end(), "email"))
        at = text.find("@", at + 1)
    for m in _DIGITS.finditer(text):
        out += [(m.start() + start, m.start() + stop, kind) for start, stop, kind in _numbers(m.group())]
    for m in _ASSIGNED.finditer(text):
        s = m.group(1)
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            out.append((m.start(1), m.end(1), "secret"))
    out += [(m.start(), m.end(), "secret") for m in _KEY.finditer(text)]
    out += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if len(m.group()) > 14]
    kept: list[tuple[int, int, str]] = []
    for c in sorted(set(out), key=lambda c: (c[0], -c[1], c[2])):
        if kept and c[0] < kept[-1][1]:
            if c[1] - c[0] > kept[-1][1] - kept[-1][0]:
                kept[-1] = c
            continue
        kept.append(c)
    return kept


def votes(text: str, start: int, stop: int, kind: str) -> str:
    """kind|votes|features: one character a labeler, then what else the classifier sees."""
    s = text[start:stop]
    digits = re.sub(r"\D", "", s)
    plain = re.sub(r"[ \-]", "", s)
    pattern = "+" if _STRICT[kind].fullmatch(plain if kind == "iban" else s) else "-"
    gazetteer = checksum = "0"
    if kind == "email":
        gazetteer = "+" if s.rsplit(".", 1)[1].lower() in _ENDINGS else "-"
        checksum = "-" if ".." in s or len(s) > 254 else "0"
    elif kind == "phone":
        if s[0] == "+":
            gazetteer = "+" if any(digits.startswith(c) for c in _DIALLING) else "-"
        checksum = "-" if not 8 <= len(digits) <= 15 or len(set(digits)) < 3 or re.fullmatch(r"(?:19|20)\d\d[-/. ]\d\d[-/. ]\d\d.*", s) else "0"
    elif kind == "ip":
        octets = [int(x) for x in s.split(".")]
        checksum = "+" if all(x < 256 for x in octets) and not any(len(x) > 1 and x[0] == "0" for x in s.split(".")) else "-"
        gazetteer = "-" if octets[0] in (0, 127) or octets[0] >= 240 else "0"
    elif kind == "card":
        gazetteer = "+" if digits[0] in "3456" or digits[:2] in ("22", "23", "24", "25", "26", "27") else "-"
        checksum = "+" if luhn(digits) and len(set(digits)) > 2 else "-"
    elif kind == "secret":
        gazetteer = "+" if _KEY.match(s) else "0"
        checksum = "+" if len(set(s)) >= 10 and len(digits) >= 3 else "-"
    elif kind == "iban":
        gazetteer = "+" if _IBAN_LENGTH.get(plain[:2]) == len(plain) else "-"
        checksum = "+" if _mod97(plain) else "-"
    elif kind == "national_id":
        gazetteer = "-" if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[-4:] == "0000" else "0"
        checksum = gazetteer
    before = [w.lower() for w in _WORD.findall(text, max(0, start - 48), start)][-4:]
    context = "-" if any(w in _AGAINST for w in before) else "+" if any(w in _CUES[kind] for w in before) else "0"
    left, right = text[start - 1 : start] if start else "", text[stop : stop + 1]
    glued = left.isalnum() or right.isalnum() or left in {"_", "$", "€"} or (left == "." and text[start - 2 : start - 1].isdigit()) or (right == "." and text[stop + 1 : stop + 2].isdigit())
    edges = "-" if glued else "+" if (not left or left in " \t\n\"'(<[") and (not right or right in " \t\n\"')>].,;") else "0"
    parted = "1" if any(c in " -.()/" for c in s) else "0"
    length = str(min(9, len(digits) // 3))
    return f"{kind}|{pattern}{gazetteer}{context}{checksum}{edges}|{parted}{length}"


def find_candidates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, stop, kind, code) of each candidate; places count characters. NULL and empty texts have none."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                row, start, stop, kind, code = [], [], [], [], []
                for i, t in enumerate(pc.fill_null(batch.column(1).slice(a, b - a), "").to_pylist()):
                    for x, y, k in candidates(t):
                        row.append(a + i)
                        start.append(x)
                        stop.append(y)
                        kind.append(k)
                        code.append(votes(t, x, y, k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(kind, pa.string()), pa.array(code, pa.string())], names=["__wa_key", "start", "stop", "kind", "code"])

    named = docs.select(F.col(f"`{key}`").alias("__wa_key"), F.col(f"`{text}`").cast("string").alias("__wa_text"))
    return named.mapInArrow(run, f"__wa_key {named.schema[0].dataType.simpleString()}, start bigint, stop bigint, kind string, code string")


@dataclass
class Model:
    """Probabilities by code, and by kind and labeler how often each vote falls on personal data and on other spans."""

    posterior: dict[str, float]
    reliability: dict[tuple[str, str], np.ndarray]
    weights: dict[str, float]

    def probability(self, code: str) -> float:
        return float(1 / (1 + np.exp(-sum(self.weights.get(x, 0.0) for x in features_of(code)))))


def features_of(code: str) -> list[str]:
    kind, vote, rest = code.split("|")
    return [kind, *(f"{kind}:{n}{v}" for n, v in zip(LABELERS, vote, strict=True)), *(f"{n}{v}" for n, v in zip(LABELERS, vote, strict=True)), f"{kind}:parted{rest[0]}", f"{kind}:length{rest[1]}"]


#: By vote (-, 0, +): how labelers are assumed to vote on other spans and on personal data.
_ASSUMED = {
    "pattern": np.array([[0.7, 0.1, 0.2], [0.05, 0.1, 0.85]]),
    "gazetteer": np.array([[0.5, 0.35, 0.15], [0.05, 0.4, 0.55]]),
    "context": np.array([[0.35, 0.6, 0.05], [0.05, 0.7, 0.25]]),
    "checksum": np.array([[0.75, 0.15, 0.1], [0.05, 0.25, 0.7]]),
    "edges": np.array([[0.5, 0.25, 0.25], [0.08, 0.27, 0.65]]),
}


def estimate(counts: dict[str, int], iterations: int = ITERATIONS, prior: float = PRIOR) -> Model:
    """Expectation-maximisation over counts by code, then the classifier that is trained on its probabilities.

    The assumed quality of labelers weighs in as a fixed share of a kind's candidates, so the result depends on the
    corpus's make-up and not on its size, and the two classes can't trade places.
    """
    reliability, posterior = {}, {}
    for kind in sorted({c.split("|")[0] for c in counts}):
        codes = sorted(c for c in counts if c.startswith(kind + "|"))
        n = np.array([counts[c] for c in codes], float)
        v = np.array([["-0+".index(x) for x in c.split("|")[1]] for c in codes])
        theta = np.stack([_ASSUMED[name] for name in LABELERS])  # labeler, class, vote
        share, strength = 0.5, prior * n.sum()
        for _ in range(iterations):
            log = np.log(np.array([1 - share, share]))[None, :] + sum(np.log(theta[k][:, v[:, k]]).T for k in range(len(LABELERS)))
            p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
            share = (float((n * p).sum()) + 0.5 * strength) / (n.sum() + strength)
            for k, name in enumerate(LABELERS):
                for c, w in ((0, n * (1 - p)), (1, n * p)):
                    seen = np.bincount(v[:, k], w, 3) + strength * _ASSUMED[name][c]
                    theta[k, c] = seen / seen.sum()
        posterior |= dict(zip(codes, p.tolist(), strict=True))
        reliability |= {(kind, name): theta[k] for k, name in enumerate(LABELERS)}
    return Model(posterior, reliability, _train(counts, posterior))


def _train(counts: dict[str, int], target: dict[str, float], ridge: float = 1e-3, steps: int = 30) -> dict[str, float]:
    """Logistic regression on soft targets by Newton steps; counts are taken as shares, so its size doesn't matter."""
    codes = sorted(counts)
    names = sorted({f for c in codes for f in features_of(c)})
    if not codes:
        return {}
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(codes), len(names)))
    for i, c in enumerate(codes):
        x[i, [place[f] for f in features_of(c)]] = 1
    n = np.sqrt(np.array([counts[c] for c in codes], float))  # rare patterns count for more than their share
    n = n / n.sum()
    y = np.array([target[c] for c in codes])
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + ridge * w
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(len(names))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(names, w.tolist(), strict=True))


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", flag_at: float = FLAG_AT) -> DataFrame:
    """(key, kind, start, stop, probability): a row for each span that the classifier takes for personal data.

    start and stop count characters. NULL and empty texts have no span, and neither has an empty table; a NULL key stays NULL, and
    rows that repeat have their spans as often. Texts are read whole. Columns but the two named aren't read, so others' names
    don't matter. Counts of vote patterns cover every candidate; the number of patterns is bounded by the labelers.
    """
    spark = docs.sparkSession
    found = Stored(spark, "pii").write(find_candidates(docs, text, key), "candidates")
    counts = {r["code"]: r["count"] for r in found.groupBy("code").count().collect()}  # at most kinds x votes x features
    model = estimate(counts)
    scored = [(c, round(model.probability(c), 6)) for c in sorted(counts)]
    table = spark.createDataFrame([x for x in scored if x[1] >= flag_at], "code string, probability double")
    return found.join(F.broadcast(table), "code").select(F.col("__wa_key").alias(key), "kind", "start", "stop", "probability")


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", flag_at: float = FLAG_AT) -> DataFrame:
    """docs with each span that detect() finds written over as <KIND>; other columns, and rows, stay as they are.

    The classifier's decisions reach the texts as a table of vote patterns, so texts aren't shuffled.
    """
    spark = docs.sparkSession
    counts = {r["code"]: r["count"] for r in find_candidates(docs, text, key).groupBy("code").count().collect()}
    model = estimate(counts)
    shipped = spark.sparkContext.broadcast({c for c in counts if round(model.probability(c), 6) >= flag_at})

    @F.pandas_udf("string")
    def mask(texts):
        def one(t):
            if t is None:
                return None
            for x, y, k in reversed(candidates(t)):
                if votes(t, x, y, k) in shipped.value:
                    t = f"{t[:x]}<{k.upper()}>{t[y:]}"
            return t

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text, mask(F.col(f"`{text}`")))
