"""PII by weak supervision: labelers vote on candidate spans, EM weighs the labelers, a classifier decides."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Fixed kinds, in the order that settles ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "hidden_email", "local_phone", "id_number", "secret")
BASE = KINDS[:4]
# Fixed patterns. Possessive quantifiers match the same spans as greedy ones here, without deep recursion or
# quadratic retries: what follows each run can't be a part of it, and a match can only begin where a run does
# or where the last match ended. A card's pattern takes whole runs of digits, as the contract's greedy one does, but
# only those of 14 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "hidden_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[a-z0-9-]{2,63}){1,4}",
    "local_phone": r"(?<![0-9+(.\x20-])\x20?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[a-z0-9_/+=.-]{12,}",
}
#: What a text must contain before its pattern is tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "hidden_email": "at", "local_phone": None, "card": None, "id_number": "-", "secret": None}
# Fixed word lists.
CUES = "e-?mail|mail|contact|write|phone|call|tel|fax|mobile|cell|card|visa|master|amex|credit|pay|ip|host|server|address|login|ssn|social|passport|user|key|token"
NOT_CUES = "version|isbn|issn|order|invoice|ref|serial|part|page|chapter|model|build|release|doi"
TLDS = "com|org|net|edu|gov|mil|info|biz|io|co|uk|de|fr|es|it|nl|be|ch|at|eu|us|ca|au|in|jp|cn|ru|br|pl|se|no|dk|fi|pt|ie|nz|mx|ar"
CODES = "1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[12368]|23[3-7]|25[1-6]|35[0-9]|37[0-9]|38[0-9]|42[01]|85[2356]|88[06]|96[0-8]|97[1-7]"
VOTERS = ("form", "gazetteer", "context", "layout", "variety")
#: What only the classifier sees of a span: four classes of length, and whether a mark like ':' or '=' stands before it.
SHAPES = 8
MIN_PROBABILITY = 0.9
ROUNDS = 40


def _found(text: Column, kind: str) -> tuple[Column, Column]:
    """The matches of a kind, and what lies before, between and after them."""
    needed = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    if kind in ("ip", "card", "phone", "local_phone", "id_number"):
        needed = needed & F.col("numeric")
    if kind == "secret":
        needed = needed & text.rlike(r"[:=]")
    pattern = F.lit(PATTERNS[kind])
    none = F.array().cast("array<string>")
    return F.when(needed, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none), F.when(needed, F.split(text, PATTERNS[kind], -1)).otherwise(none)


def _scan(name: str, step: str) -> str:
    """SQL for all running sums (or greatest values: whatever step says of x and y) of the array name.

    Each round reaches twice as far as the one before, so the work is n log n and no array is built element by element.
    """
    return f"""if(size({name}) < 2, {name}, aggregate(sequence(0, cast(ceil(log2(size({name}))) as int) - 1), {name},
        (s, k) -> transform(s, (x, i) -> if(i < shiftleft(1, k), x, {step.replace('y', 'get(s, i - shiftleft(1, k))')}))))"""


def _placed(kind: str) -> Column:
    """Structs of start, body and the 40 characters before, in order. Starts are running sums of what came before."""
    return F.expr(f"transform(arrays_zip(z_{kind}, e_{kind}), x -> named_struct('at', x.e_{kind} - length(x.z_{kind}.m), 'body', x.z_{kind}.m, 'before', lower(right(x.z_{kind}.g, 40))))")


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _valid(kind: str, body: Column) -> Column:
    """Whether a match of a base kind stands."""
    digits = _digits(body)
    if kind == "ip":
        return body.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})\.){3}0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, body: Column, before: Column) -> dict[str, Column]:
    digits, none = _digits(body), F.lit(False)
    form = {
        "hidden_email": _vote(body.rlike(rf"(?i)(?:dot[)\]}}]|\.)\x20?({TLDS})$"), none),
        "local_phone": _vote(digits.rlike("^[2-9][0-9]{2}[2-9]"), ~digits.rlike("^[2-9][0-9]{2}[2-9]")),
        "id_number": _vote(~digits.rlike("^(000|666|9)|^...00|0000$"), digits.rlike("^(000|666|9)|^...00|0000$")),
        "secret": _vote(body.rlike("[0-9]") & body.rlike("(?i)[:=].*[a-z]"), ~body.rlike("[0-9]")),
    }.get(kind, F.lit(1))
    gazetteer = {
        "email": _vote(body.rlike(rf"(?i)\.({TLDS})$"), none),
        "ip": _vote(~body.rlike(r"^0*(0|255)\."), body.rlike(r"^0*(0|255)\.")),
        "card": _vote(digits.rlike("^(4|5[1-5]|2[2-7]|3[4-7]|6)"), ~digits.rlike("^[2-6]")),
        "phone": _vote(digits.rlike(f"^({CODES})"), ~digits.rlike(f"^({CODES})")),
        "hidden_email": _vote(body.rlike("(?i)mail|example|post"), none),
        "secret": _vote(body.rlike(r"(?i)[:=]\s*[\"']?(sk|pk|gh[ps]|xox|AKIA|eyJ)") | body.rlike(r"[:=]\s*[\"']?[0-9a-f]{24,}"), none),
    }.get(kind, F.lit(0))
    context = _vote(before.rlike(rf"\b({CUES})\b[^a-z0-9]{{0,6}}([a-z]+[^a-z0-9]{{1,3}}){{0,2}}$"), before.rlike(rf"\b({NOT_CUES})\b[^a-z0-9]{{0,6}}$"))
    layout = {
        "email": _vote(~body.rlike(r"^[.%-]|\.\.|@-|\.-"), body.rlike(r"^[.%-]|\.\.|@-|\.-")),
        "ip": _vote(~body.rlike(r"(^|\.)0[0-9]"), body.rlike(r"(^|\.)0[0-9]")),
        "card": _vote(body.rlike(r"^[0-9]+$|^([0-9]{4}[\x20-]){3}[0-9]{2,7}$"), body.rlike(r"[0-9][\x20-][0-9][\x20-][0-9][\x20-]")),
        "phone": _vote(body.rlike(r"[\x20().-]"), body.rlike(r"[().\x20-]{4}")),
        "local_phone": _vote(body.rlike(r"^\x20?\([0-9]{3}\)\x20|^\x20?[0-9]{3}([.-])[0-9]{3}\1"), none),
        "id_number": F.lit(1),
        "secret": _vote(body.rlike("[\"'][a-zA-Z0-9_/+=.-]{20,}"), ~body.rlike("[a-zA-Z0-9_/+=.-]{16,}$")),
    }.get(kind, F.lit(0))
    distinct = F.size(F.array_distinct(F.split(body, "")))
    variety = _vote(distinct >= 6, distinct <= 3)
    return dict(zip(VOTERS, (form, gazetteer, context, layout, variety), strict=True))


def _shape(body: Column, before: Column) -> Column:
    n = F.length(body)
    return F.when(n < 12, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3) + F.when(before.rlike(r"[:=#>][\x20\"']{0,2}$"), 4).otherwise(0)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, mark and cands: an array of structs start, rank (of the kind), end, base, shape and the votes."""
    text = text_of(docs)
    df = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"), text.rlike("[0-9]").alias("numeric"))
    found = {k: _found(F.col("text"), k) for k in KINDS}
    df = df.select("doc_id", "mark", *[c.alias(f"{p}_{k}") for k, pair in found.items() for p, c in zip("mg", pair, strict=True)])
    matched = lambda k: F.expr(f"filter(zip_with(m_{k}, g_{k}, (m, g) -> named_struct('m', m, 'g', g)), x -> x.m is not null)")
    df = df.select("doc_id", "mark", *[matched(k).alias(f"z_{k}") for k in KINDS])
    df = df.select("*", *[F.expr(f"transform(z_{k}, x -> cast(length(x.g) + length(x.m) as bigint))").alias(f"l_{k}") for k in KINDS])
    df = df.select("*", *[F.expr(_scan(f"l_{k}", "x + y")).alias(f"e_{k}") for k in KINDS])
    df = df.select("doc_id", "mark", *[_placed(k).alias(k) for k in KINDS])

    def judged(kind: str) -> Column:
        rank, base = KINDS.index(kind), kind in BASE
        spans = F.filter(F.col(kind), lambda x: _valid(kind, x["body"])) if base else F.col(kind)
        return F.transform(spans, lambda x: F.struct(
            (x["at"] + F.when(x["body"].startswith(" "), 1).otherwise(0)).alias("start"), F.lit(rank).alias("rank"), (x["at"] + F.length(x["body"])).alias("end"), F.lit(base).alias("base"),
            _shape(x["body"], x["before"]).cast("int").alias("shape"), *[v.cast("int").alias(n) for n, v in _votes(kind, x["body"], x["before"]).items()]))

    spans = df.select("doc_id", "mark", F.sort_array(F.concat(*[judged(k) for k in KINDS])).alias("spans"))
    # Along the sorted spans: the greatest end of a base span so far, and from the end on the least start of one.
    spans = spans.select("*", F.expr("transform(spans, s -> if(s.base, s.end, -1L))").alias("ends"), F.expr(f"reverse(transform(spans, s -> if(s.base, s.start, {1 << 60}L)))").alias("starts"))
    spans = spans.select("doc_id", "mark", "spans", F.expr(_scan("ends", "greatest(x, y)")).alias("ends"), F.expr(f"reverse({_scan('starts', 'least(x, y)')})").alias("starts"))
    clear = "filter(transform(arrays_zip(spans, ends, starts), x -> if(x.spans.base or (x.ends <= x.spans.start and x.starts >= x.spans.end), x.spans, null)), x -> x is not null)"
    return spans.select("doc_id", "mark", F.expr(clear).alias("cands"))


def reliabilities(cells: list[tuple], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns (rank, base, shape, votes..., n); the shape is left to the classifier.

    Returns how often a voter that speaks says -1 and 1 of wrong and of true spans (voter, truth, vote), and for each
    cell the probability that it is true. Silence is no evidence: many voters know nothing of a kind. Truth starts
    from the majority; each kind has its own share of true spans.
    """
    rank, base = np.array([c[0] for c in cells]), np.array([bool(c[1]) for c in cells])
    votes, n = np.array([c[3:-1] for c in cells], int), np.array([c[-1] for c in cells], float)
    true = 1 / (1 + np.exp(-(votes.sum(axis=1) + np.where(base, 2.0, -1.0))))
    for _ in range(rounds):
        says = np.empty((votes.shape[1], 2, 2))
        for t, share in enumerate((1 - true, true)):
            for k, v in enumerate((-1, 1)):
                says[:, t, k] = (votes == v).T @ (n * share) + ((6.0, 2.0), (1.0, 6.0))[t][k]
        says /= says.sum(axis=2, keepdims=True)
        prior = np.array([(float((n * true)[rank == k].sum()) + 1) / (float(n[rank == k].sum()) + 2) for k in rank])
        weight = np.log(says[:, 1] / says[:, 0])
        log = np.log(prior / (1 - prior)) + (votes == -1) @ weight[:, 0] + (votes == 1) @ weight[:, 1]
        true = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return says, true


def classifier(cells: list[tuple], true: np.ndarray, steps: int = 25, ridge: float = 1.0) -> dict:
    """Logistic regression on the votes, the kind and the shape, fitted to EM's probabilities: weights of each."""
    names = [(v, s) for v in range(len(VOTERS)) for s in (-1, 1)]
    x = np.array([[float(c[3 + v] == s) for v, s in names] + [float(c[0] == k) for k in range(len(KINDS))] + [float(c[2] == k) for k in range(SHAPES)] for c in cells])
    n, w = np.array([c[-1] for c in cells], float), np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (true - p)) - ridge * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"votes": dict(zip(names, w.tolist(), strict=False)), "kinds": w[len(names) : -SHAPES].tolist(), "shapes": w[-SHAPES:].tolist()}


def personal_data(docs: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, mark, spans (array of struct start, rank, end, base); a row for each row of docs.

    Base spans are the valid leftmost matches of the base kinds and always stay. Candidates of the looser kinds that
    touch no base span stay if the classifier gives them min_probability. The labelers' votes are counted by pattern
    (3 to the power of 5, times kinds and shapes: at most 15,552 counts reach the driver), EM turns the counts into
    reliabilities and probabilities, and a logistic classifier is trained on those.

    Null text: empty, no spans. Null or repeated doc_id: each row for itself. Only doc_id and text are read.
    Empty table: no rows. A table without candidates: no classifier, no spans.
    """
    found = cut(candidates(docs), "candidates")
    one = found.select(F.explode("cands").alias("c")).select("c.*")
    cells = [tuple(r) for r in one.groupBy("rank", "base", "shape", *VOTERS).agg(F.count("*").alias("n")).orderBy("rank", "base", "shape", *VOTERS).collect()]
    if not cells:
        return found.select("doc_id", "mark", F.col("cands").alias("spans"))
    _, true = reliabilities(cells)
    model = classifier(cells, true)
    edge = math.log(min_probability / (1 - min_probability))

    def stays(c: Column) -> Column:
        score = F.element_at(F.array(*[F.lit(w) for w in model["kinds"]]), c["rank"] + 1) + F.element_at(F.array(*[F.lit(w) for w in model["shapes"]]), c["shape"] + 1)
        for (v, s), w in model["votes"].items():
            score = score + F.when(c[VOTERS[v]] == s, F.lit(w)).otherwise(F.lit(0.0))
        return c["base"] | (score >= edge)

    return found.select("doc_id", "mark", F.filter("cands", stays).alias("spans"))


def op4_pii(docs: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return personal_data(docs).select(
        "doc_id", *[count(k) for k in BASE], F.sha2(said(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )
