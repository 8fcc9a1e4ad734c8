"""Line rules by the thousand: one automaton over all their literals, one pass over a text.

``rules.scan`` gives each rule expressions of its own, which suits the handful that come with the library.  Here all
rules travel in one broadcast; a worker builds an Aho-Corasick automaton over their literals once, runs it over each
text, and tries a rule's pattern only on the lines where one of its literals stands.  The plan has one expression
however many rules there are, and a text costs its length and its hits.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.pystr import PY_SPACE
from riskweave.operators.rules import FINDING_COLUMNS, SEVERITY_RANK, LineRule

#: Rules are broadcast, so their patterns have a bound in characters.
MOST_CHARS = 32 << 20
FOUND = "array<struct<line_number:int,rule:int,code_snippet:string>>"
#: Letters that match an ASCII letter when case is ignored, but are not that letter's capital.
ALIKE = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    return text.translate(ALIKE).lower()


class RuleSet:
    """Rules in order of their findings; the automaton is built where it is used."""

    def __init__(self, rules: tuple[LineRule, ...]):
        self.patterns = [r.pattern for r in rules]
        # A literal with other letters has more spellings than ``folded`` knows: such a rule tries every line.
        self.literals = [tuple(x for x in r.literals) if r.literals and all(x.isascii() and x for x in r.literals) else () for r in rules]
        self._ready = None

    def __getstate__(self):
        return {"patterns": self.patterns, "literals": self.literals, "_ready": None}

    def ready(self):
        if self._ready is None:
            import ahocorasick

            of: dict[str, list[int]] = {}
            for i, literals in enumerate(self.literals):
                for literal in literals:
                    of.setdefault(folded(literal), []).append(i)
            automaton = ahocorasick.Automaton()
            for literal, owners in of.items():
                automaton.add_word(literal, (len(literal), tuple(owners)))
            if of:
                automaton.make_automaton()
            self._ready = (automaton if of else None, [i for i, x in enumerate(self.literals) if not x], {})
        return self._ready

    def _tries(self, text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
        """``(line from 0, rule)`` pairs that a pattern must be tried on."""
        automaton, always, _ = self.ready()
        if automaton is not None:
            for end, (size, owners) in automaton.iter(folded(text)):
                line = bisect_right(starts, end - size + 1) - 1
                if line + 1 == len(starts) or end < starts[line + 1] - 1:
                    yield from ((line, i) for i in owners)
        for line in range(len(starts) if always else 0):
            yield from ((line, i) for i in always)

    def found(self, text: str) -> list[tuple[int, int, str]]:
        """``(line from 1, rule, line without outer blanks)`` of all matches, by line and rule."""
        lines = text.split("\n")
        starts, at = [], 0
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        compiled, out = self.ready()[2], []
        for line, i in sorted(set(self._tries(text, starts))):
            pattern = compiled.get(i) or compiled.setdefault(i, re.compile(self.patterns[i], re.IGNORECASE))
            if pattern.search(lines[line]):
                out.append((line + 1, i, lines[line].strip(PY_SPACE)))
        return out


def _parses(code: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def findings(files: DataFrame, rules, parsed_only: bool = True) -> DataFrame:
    """The findings of many line rules, in the columns of ``rules.findings`` and equal to it rule by rule.

    A file that does not parse has none, unless ``parsed_only`` is false.  Null texts have none.  No shuffle: the rules'
    names and severities are joined from the broadcast they came in.
    """
    rules = tuple(rules)
    chars = sum(len(r.pattern) + sum(map(len, r.literals)) for r in rules)
    if chars > MOST_CHARS:
        raise ValueError(f"rules of {chars} characters; at most {MOST_CHARS} are broadcast")
    spark = files.sparkSession
    held = spark.sparkContext.broadcast(RuleSet(rules))

    def run(codes: pa.Array) -> pa.Array:
        out = []
        for code in codes:
            text = code.as_py() or ""
            hits = held.value.found(text)
            out.append([{"line_number": n, "rule": i, "code_snippet": s} for n, i, s in hits] if hits and (not parsed_only or _parses(text)) else [])
        return pa.array(out, pa.list_(pa.struct([("line_number", pa.int32()), ("rule", pa.int32()), ("code_snippet", pa.string())])))

    # As in ``rules.findings``, columns named like a finding's are replaced.
    carried = [c for c in files.columns if c not in ("code", "rank", "rule", *FINDING_COLUMNS)]
    scanned = files.select(*carried, F.arrow_udf(run, FOUND).asNondeterministic()(F.col("code")).alias("_found"))
    rows = scanned.select(*carried, F.inline("_found"))
    # One row per rule; bounded as above.
    kinds = spark.createDataFrame(
        pa.table({
            "rule": pa.array(range(len(rules)), pa.int32()), "rank": pa.array([SEVERITY_RANK.get(r.severity, 5) for r in rules], pa.int32()),
            "vulnerability_type": [r.key for r in rules], "severity": [r.severity for r in rules], "description": [r.description for r in rules],
            "confidence": pa.array([float(r.confidence) for r in rules]), "rule_id": [r.key.upper() for r in rules],
        })
        if rules else [], "rule int, rank int, vulnerability_type string, severity string, description string, confidence double, rule_id string",
    )
    return rows.withColumn("column_number", F.lit(0)).join(F.broadcast(kinds), "rule").select(*carried, "rank", "rule", *FINDING_COLUMNS)
