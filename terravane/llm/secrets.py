"""Secret scan: all rules in one automaton, one pass over the bytes of every whole text."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terravane.llm.automaton import Automaton, Backward, Rule, compile_rules, run
from terravane.llm.common import Texts, batches, id_and_text

#: The rules. The first three are the base kinds, in their listed order.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", ignore_case=True, min_tail=6),
    Rule("access", r"AKIA[A-Z0-9]+", min_total=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]+", min_total=40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", min_total=20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", min_total=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", min_total=32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3


@lru_cache(maxsize=4)
def _compiled(rules: tuple) -> Automaton:
    return compile_rules(rules)


@lru_cache(maxsize=64)
def _backward(rule: Rule) -> Backward:
    return Backward(rule)


def find_spans(a: Automaton, data: np.ndarray, bounds: np.ndarray) -> dict[int, list]:
    """Row number -> [(start, rule number, end)] in code points, ordered; rows without any are absent."""
    pos, masks = run(a, data, bounds)
    out: dict[int, list] = {}
    for k, rule in enumerate(a.rules):
        p = pos[(masks >> k) & 1 == 1]
        if not len(p):
            continue
        row = np.searchsorted(bounds, p, "right") - 1
        first = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(row) != 0)])
        end = p[np.r_[first[1:] - 1, len(p) - 1]] + 1
        begin, row = p[first], row[first]
        # rows of equal texts before row[first] may be empty: the last row that starts at or before p is meant
        back = _backward(rule)
        before = -1
        for b, e, r in zip(begin.tolist(), end.tolist(), row.tolist(), strict=True):
            s = back.start(data, b, max(int(bounds[r]), before))
            before = e
            if e - s >= rule.min_total and e - b >= rule.min_tail:
                out.setdefault(r, []).append((s - int(bounds[r]), k, e - int(bounds[r])))
    for r, spans in out.items():
        own = data[bounds[r] : bounds[r + 1]]
        if (own >= 0x80).any():
            points = np.r_[0, np.cumsum((own & 0xC0) != 0x80)]
            out[r] = [(int(points[s]), k, int(points[e])) for s, k, e in spans]
        out[r].sort()
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES, base: int = BASE) -> DataFrame:
    """One row per input row: doc_id, n_<kind> of each rule, base_sha256 and spans.

    Spans are kind:start:end in code points (end exclusive), by start, then by the rule's place.
    base_sha256 hashes the spans of the first `base` rules. Null and empty texts have no spans; a
    null id stays null; repeated rows come back as often as they occur; other columns are not read.
    Only the compiled table (some hundred KB, whatever the input) goes to the executors.
    """
    rules = tuple(rules)
    automaton = _compiled(rules)
    spec = [("doc_id", pa.int64()), *((f"n_{r.kind}", pa.int64()) for r in rules), ("base_sha256", pa.string()), ("spans", pa.string())]

    @batches(spec)
    def scan(batch):
        texts = Texts(batch.column(1))
        n = len(texts)
        counts = np.zeros((len(rules), n), np.int64)
        none = hashlib.sha256(b"").hexdigest()
        digests, spans = [none] * n, [""] * n
        for i, j in texts.pieces(4 << 20):
            bounds = texts.bounds[i : j + 1] - texts.bounds[i]
            for r, found in find_spans(automaton, texts.data[texts.bounds[i] : texts.bounds[j]], bounds).items():
                said = [f"{rules[k].kind}:{s}:{e}" for s, k, e in found]
                for _, k, _ in found:
                    counts[k, i + r] += 1
                spans[i + r] = ",".join(said)
                digests[i + r] = hashlib.sha256(",".join(x for x, (_, k, _) in zip(said, found, strict=True) if k < base).encode()).hexdigest()
        return [batch.column(0), *counts, digests, spans]

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in spec))
