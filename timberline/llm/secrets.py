"""Secret scan: pattern matches, and a likelihood test by automata inferred from labelled credentials.

Credentials that the patterns label are a training sample, split by the classes of characters they have. For each
part a prefix tree is generalised by merging states whose outgoing frequencies are statistically compatible
(Hoeffding bound). Only states of one depth merge, so the automaton keeps what makes a format: its prefix, its
length, and the characters at each place. Ordinary runs (letters alone, or digits alone) give automata too, whose
states merge at any depth. Every token-like run of the corpus is scored: it is a secret if some credential
automaton explains it far better than all those of ordinary runs do.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Scratch, map_arrow, small_batches, texts_of

KINDS = ("assign", "access", "hex")
GRAMMAR = "grammar"
#: Training strings of each automaton, taken by the order of their hashes over the whole corpus.
SAMPLE = 300
#: Longer training strings are left out of the prefix tree (they are still scored).
TRAIN_CHARS = 200
#: Significance of the Hoeffding test; smaller values merge more.
ALPHA = 0.05
#: Ordinary runs: a part of the unlabelled ones by what they consist of, which no credential format is made of alone.
ORDINARY = {"word": "^[A-Z]?[a-z]+$", "capitals": "^[A-Z]+$", "number": "^[0-9]+$"}
#: Natural-log likelihood ratio, in all and for each character, that a secret must exceed.
LEAST_RATIO, LEAST_RATIO_PER_CHAR = 15.0, 0.8

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that are scored; shorter ones are too short for the least ratio.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Scored strings of up to MEMO_CHARS that a worker remembers.
MEMO, MEMO_CHARS = 100_000, 100
#: Characters that a run may have, and the count that each has before any is seen.
_ALPHABET, _PRIOR = 66, 0.1


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the credential) of the pattern matches, sorted."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Token-like runs that overlap no base span."""
    out, k, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        # ``reach`` is where the base spans that start before the end of the run end; spans are sorted by start.
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def characters(s: str) -> str:
    """Which classes of characters a credential has; formats differ by them."""
    return "".join(k for k, found in (("a", _LOWER.search(s)), ("A", _UPPER.search(s)), ("0", _DIGIT.search(s)), ("-", _OTHER.search(s))) if found)


_LOWER, _UPPER, _DIGIT, _OTHER = re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"), re.compile("[^A-Za-z0-9]")


class Automaton:
    """A probabilistic finite automaton inferred by merging compatible states of a prefix tree, of one depth if ``layered``."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, layered: bool = True):
        self.layered, self.depth = layered, [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]
        for s in strings:
            at = 0
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.end.append(0)
                    self.depth.append(self.depth[at] + 1)
                at = self.next[at][c]
            self.end[at] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._generalise()
        self._score()

    def _total(self, q: int) -> int:
        return self.end[q] + sum(self.count[q].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self._total(a), self._total(b)
            if not n1 or not n2:
                continue
            if self._differ(self.end[a], n1, self.end[b], n2):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), n1, self.count[b].get(c, 0), n2):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, q: int) -> None:
        """Adds the tree below q to the state ``into``."""
        todo = [(into, q)]
        while todo:
            a, b = todo.pop()
            self.end[a] += self.end[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, target in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], target))
                else:
                    self.next[a][c] = target

    def _generalise(self) -> None:
        red, known = [0], {0}
        while True:
            blue = sorted((-self._total(t), q, c) for q in red for c, t in self.next[q].items() if t not in known)
            if not blue:
                break
            _, q, c = blue[0]
            state = self.next[q][c]
            for r in red:
                if (not self.layered or self.depth[r] == self.depth[state]) and self._compatible(r, state):
                    self.next[q][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
                known.add(state)
        self.states = red

    def _score(self) -> None:
        """Log probabilities: of each state's n observations of k kinds, k / (n + k) of the mass goes by the overall shares."""
        totals = [self._total(q) for q in self.states]
        seen: dict[str, int] = {}
        for q in self.states:
            for c, n in self.count[q].items():
                seen[c] = seen.get(c, 0) + n
        ends, letters = sum(self.end[q] for q in self.states), sum(seen.values())
        stop = (ends + _PRIOR) / (ends + letters + 2 * _PRIOR)
        share = lambda n: (1 - stop) * (n + _PRIOR) / (letters + _ALPHABET * _PRIOR)
        shares = {c: share(n) for c, n in seen.items()}
        self.log_share, self.log_rare, self.log_stop = {c: math.log(p) for c, p in shares.items()}, math.log(share(0)), math.log(stop)
        self.step: dict[int, dict[str, tuple[float, int]]] = {}
        self.log_end: dict[int, float] = {}
        self.log_back: dict[int, float] = {}
        fullest: dict[int, tuple[int, int]] = {}
        for q, n in zip(self.states, totals, strict=True):
            k = len(self.count[q]) + (self.end[q] > 0)
            back = k / (n + k) if n else 1.0
            self.log_back[q] = math.log(back)
            self.step[q] = {c: (math.log((1 - back) * m / n + back * shares[c]), self.next[q][c]) for c, m in self.count[q].items()}
            self.log_end[q] = math.log((1 - back) * self.end[q] / n + back * stop) if n else math.log(stop)
            fullest[self.depth[q]] = max(fullest.get(self.depth[q], (0, 0)), (n, q))
        # After a character that a state has not seen: the fullest state of the next depth, or the same state.
        self.after = {q: (fullest[self.depth[q] + 1][1] if self.depth[q] + 1 in fullest else None) if self.layered else q for q in self.states}

    def log_likelihood(self, s: str) -> float:
        """Of the whole string. Beyond the last depth of a layered automaton the overall shares hold."""
        at, total = 0, 0.0
        for i, c in enumerate(s):
            if at is None:
                return total + sum(self.log_share.get(x, self.log_rare) for x in s[i:]) + self.log_stop
            step = self.step[at].get(c)
            if step is None:
                total += self.log_back[at] + self.log_share.get(c, self.log_rare)
                at = self.after[at]
            else:
                total += step[0]
                at = step[1]
        return total + (self.log_stop if at is None else self.log_end[at])


class SecretModel:
    """Automata of the credentials of each kind and class of characters, and of ordinary runs by their kind."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        parts: dict[tuple[str, str], list[str]] = {}
        for kind, values in credentials.items():
            for v in values:
                parts.setdefault((kind, characters(v)), []).append(v)
        plain: dict[str, list[str]] = {}
        for v in ordinary:
            name = next((n for n, pattern in ORDINARY.items() if re.match(pattern, v)), None)
            if name:
                plain.setdefault(name, []).append(v)
        self.formats = {k: Automaton(v) for k, v in sorted(parts.items())}
        self.ordinary = {k: Automaton(v, layered=False) for k, v in sorted(plain.items())}
        self._alone = {classes for _, classes in self.formats}
        self._memo: dict[str, bool] = {}

    def ratio(self, s: str) -> float:
        """Natural logarithm of how much likelier the string is as a credential than as an ordinary run."""
        return max(a.log_likelihood(s) for a in self.formats.values()) - max(a.log_likelihood(s) for a in self.ordinary.values())

    def is_secret(self, s: str) -> bool:
        """By the ratio; a run of letters or digits alone is ordinary unless some labelled credential has that class alone."""
        if not self.formats or not self.ordinary:
            return False
        found = self._memo.get(s)
        if found is None:
            ratio = self.ratio(s) if characters(s) in self._alone or not any(re.match(p, s) for p in ORDINARY.values()) else -math.inf
            found = ratio > LEAST_RATIO and ratio > LEAST_RATIO_PER_CHAR * len(s)
            if len(s) <= MEMO_CHARS:
                if len(self._memo) >= MEMO:
                    self._memo.clear()
                self._memo[s] = found
        return found


def scan_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, starts, kinds, ends, values): base spans with the credential strings, then candidates with kind -1."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in texts_of(batch, "_text"):
                for i, text in enumerate(texts, at):
                    text = text or ""
                    base = base_spans(text)
                    free = candidates(text, base)
                    yield {"_id": ids[i], "starts": [s[0] for s in base] + [a for a, _ in free], "kinds": [s[1] for s in base] + [-1] * len(free), "ends": [s[2] for s in base] + [b for _, b in free], "values": [text[s[3] : s[2]] for s in base] + [text[a:b] for a, b in free]}

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_arrow(narrow, rows, f"_id {kind}, starts array<bigint>, kinds array<int>, ends array<bigint>, values array<string>", 1000).withColumnRenamed("_id", id_col)


def train_model(scanned: DataFrame) -> SecretModel:
    """Infers the automata from the SAMPLE distinct strings of each kind with the least hashes, over the whole corpus."""
    each = scanned.select(F.explode(F.arrays_zip("kinds", "values")).alias("s")).select(F.col("s.kinds").alias("kind"), F.col("s.values").alias("value"))
    each = each.where(F.length("value") <= TRAIN_CHARS)
    least = lambda rows: sorted(r["value"] for r in rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.xxhash64("value"), "value").limit(SAMPLE).collect())
    credentials = {k: least(each.where(F.col("kind") == i)) for i, k in enumerate(KINDS)}
    if not any(credentials.values()):
        return SecretModel({}, [])
    ordinary = [v for pattern in ORDINARY.values() for v in least(each.where((F.col("kind") == -1) & F.col("value").rlike(pattern)))]
    return SecretModel(credentials, ordinary)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, spans array<struct<kind, start, end>>) sorted by start, then kind; a row per document.

    Offsets are code points, end exclusive. Null and empty texts have no spans; repeated rows stay. A corpus
    without labelled credentials has base spans only (so none). Other columns are dropped.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    scanned = scratch.keep(scan_patterns(docs, id_col, text_col), "scanned")
    model = train_model(scanned)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = (*KINDS, GRAMMAR)
        for batch in batches:
            for r in batch.to_pylist():
                spans = []
                for start, number, end, value in zip(r["starts"], r["kinds"], r["ends"], r["values"], strict=True):
                    if number >= 0:
                        spans.append((start, number, end))
                    elif model.is_secret(value):
                        spans.append((start, len(KINDS), end))
                yield {"_id": r[id_col], "spans": [{"kind": names[k], "start": a, "end": b} for a, k, b in sorted(spans)]}

    return map_arrow(scanned, rows, f"_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>", 2000).withColumnRenamed("_id", id_col)


def secret_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans string) from the spans of ``find_secrets``."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != GRAMMAR)
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[dict]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])



def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All documents and columns, with each secret replaced by the name of its kind in angle brackets.

    ``size_col``, if there is one, is the length of a changed text; texts without secrets, null and empty ones
    too, stay as they are. Equal texts change alike and repeated rows stay; columns keep their names and order,
    whatever these are. An empty table gives an empty one.
    """
    model = train_model(Scratch(docs.sparkSession, "redact").keep(scan_patterns(docs, id_col, text_col), "scanned"))
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, changed = batch.column(at).to_pylist(), batch.column(size_at).to_pylist() if size_at is not None else None, False
            for i, text in enumerate(texts):
                spans = spans_of(text, model) if text else []
                if spans:
                    texts[i], changed = redact(text, spans), True
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if sizes is not None:
                    columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def spans_of(text: str, model: SecretModel) -> list[dict]:
    base = base_spans(text)
    found = [(a, k, b) for a, k, b, _ in base] + [(a, len(KINDS), b) for a, b in candidates(text, base) if model.is_secret(text[a:b])]
    names = (*KINDS, GRAMMAR)
    return [{"kind": names[k], "start": a, "end": b} for a, k, b in sorted(found)]
