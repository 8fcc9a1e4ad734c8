"""Control flow of every function: blocks, edges, dominators, def-use findings and unreleased handles.

A map over files like the scan: one parse per file, nothing shuffled.  The code outside all functions is a function
named ``<module>``.  A block is a straight run of statements; statements under ``try`` are blocks of their own, with an
edge to whatever may catch what they raise.  ``finally`` is one block that every way out of its ``try`` passes.  Two
ways from one block to the same block are one edge.

Two questions are answered on the graph by fixpoints: which definitions of a variable reach a call that runs its
argument, and which opened handles may reach the function's end unclosed.
"""

from __future__ import annotations

import ast
import functools
import warnings
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "array<struct<block:int,first_line:int,last_line:int,statements:int,dominator:int,reachable:boolean>>"
EDGE = "array<struct<source:int,target:int,kind:string>>"
FLOWS = "array<struct<kind:string,variable:string,source_line:int,sink_line:int>>"
LEAKS = "array<struct<line:int,variable:string>>"
FUNCTION = f"array<struct<function:string,line:int,blocks:{BLOCK},edges:{EDGE},flows:{FLOWS},leaks:{LEAKS}>>"

#: Calls that run the string given first: attribute or dotted name, and the kind of finding.
SINKS = {
    "execute": "sql_injection", "executemany": "sql_injection", "executescript": "sql_injection",
    "os.system": "shell_injection", "os.popen": "shell_injection", "subprocess.call": "shell_injection",
    "subprocess.run": "shell_injection", "subprocess.Popen": "shell_injection", "subprocess.check_output": "shell_injection",
}
#: Calls that give a handle which must be closed.
OPENERS = frozenset({"open", "io.open", "codecs.open", "gzip.open", "bz2.open", "lzma.open", "os.fdopen", "socket.socket", "tempfile.NamedTemporaryFile", "zipfile.ZipFile", "tarfile.open"})
ENTRY, EXIT = 0, 1
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)


@dataclass
class Graph:
    """Blocks of one function; block 0 is its entry, block 1 its end."""

    blocks: list[list[ast.stmt]] = field(default_factory=lambda: [[], []])
    edges: dict[tuple[int, int], str] = field(default_factory=dict)

    def new(self) -> int:
        self.blocks.append([])
        return len(self.blocks) - 1

    def link(self, source: int | None, target: int, kind: str = "next") -> None:
        if source is not None:
            self.edges.setdefault((source, target), kind)

    def targets(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.blocks]
        for a, b in self.edges:
            out[a].append(b)
        return out

    def dominators(self) -> list[int | None]:
        """The nearest block that every way from the entry passes, for each block that the entry reaches."""
        after, order, seen = self.targets(), [], {ENTRY}
        stack = [(ENTRY, iter(after[ENTRY]))]
        while stack:
            block, rest = stack[-1]
            step = next((b for b in rest if b not in seen), None)
            if step is None:
                order.append(block)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(after[step])))
        place = {b: i for i, b in enumerate(order)}  # the entry is last
        before: dict[int, list[int]] = {b: [] for b in order}
        for a, b in self.edges:
            if a in place:
                before[b].append(a)
        near: list[int | None] = [None] * len(self.blocks)
        near[ENTRY] = ENTRY
        changed = True
        while changed:
            changed = False
            for b in reversed(order[:-1]):
                best = None
                for a in before[b]:
                    if near[a] is None:
                        continue
                    x, y = a, best
                    while y is not None and x != y:
                        if place[x] < place[y]:
                            x = near[x]
                        else:
                            y = near[y]
                    best = x
                if near[b] != best:
                    near[b], changed = best, True
        return near


class _Builder:
    """Turns statements into a graph; each method returns the block where flow goes on, or None."""

    def __init__(self, body: list[ast.stmt]):
        self.graph = Graph()
        self.loops: list[tuple[int, int, int]] = []  # head, behind, depth of the finally stack
        self.catchers: list[list[int]] = []  # where a raise may go, innermost last
        self.finals: list[tuple[int, dict[int, str]]] = []  # entry of a finally, and where its end goes on
        self.graph.link(self.run(body, ENTRY), EXIT, "return")

    def jump(self, block: int, target: int, kind: str, depth: int = 0) -> None:
        """A way out that passes every finally above ``depth``."""
        for entry, onward in reversed(self.finals[depth:]):
            self.graph.link(block, entry, kind)
            block = None
            onward_here = onward
            if self.finals[depth][0] == entry:
                onward_here[target] = kind
            else:
                outer = self.finals[self.finals.index((entry, onward)) - 1][0]
                onward_here[outer] = kind
            kind = "finally"
        if block is not None:
            self.graph.link(block, target, kind)

    def run(self, body: list[ast.stmt], block: int | None) -> int | None:
        for statement in body:
            if block is None:
                block = self.graph.new()  # nothing leads here
            if self.catchers and self.graph.blocks[block]:
                block = self.follow(block)
            block = getattr(self, f"on_{type(statement).__name__}", self.plain)(statement, block)
        return block

    def follow(self, block: int, kind: str = "next") -> int:
        behind = self.graph.new()
        self.graph.link(block, behind, kind)
        return behind

    def put(self, statement: ast.stmt, block: int) -> None:
        self.graph.blocks[block].append(statement)
        if self.catchers and not isinstance(statement, (ast.Pass, ast.Break, ast.Continue)):
            for target in self.catchers[-1]:
                self.graph.link(block, target, "raise")

    def plain(self, statement, block):
        self.put(statement, block)
        return block

    def on_If(self, statement, block):
        self.put(statement, block)
        ends = [self.run(statement.body, self.follow(block, "true"))]
        ends.append(self.run(statement.orelse, self.follow(block, "false")) if statement.orelse else block)
        return self.join(ends, ["next", "next" if statement.orelse else "false"])

    def join(self, ends, kinds):
        if all(e is None for e in ends):
            return None
        behind = self.graph.new()
        for end, kind in zip(ends, kinds):
            self.graph.link(end, behind, kind)
        return behind

    def loop(self, statement, block, endless=False):
        head = self.follow(block) if self.graph.blocks[block] or block == ENTRY else block
        self.put(statement, head)
        behind = self.graph.new()
        self.loops.append((head, behind, len(self.finals)))
        self.graph.link(self.run(statement.body, self.follow(head, "true")), head, "loop")
        self.loops.pop()
        if not endless:
            end = self.run(statement.orelse, self.follow(head, "false")) if statement.orelse else head
            self.graph.link(end, behind, "next" if statement.orelse else "false")
        return behind if any(b == behind for _, b in self.graph.edges) else None

    def on_While(self, statement, block):
        return self.loop(statement, block, isinstance(statement.test, ast.Constant) and bool(statement.test.value))

    def on_For(self, statement, block):
        return self.loop(statement, block)

    on_AsyncFor = on_For

    def on_Break(self, statement, block):
        self.put(statement, block)
        if self.loops:
            self.jump(block, self.loops[-1][1], "break", self.loops[-1][2])

    def on_Continue(self, statement, block):
        self.put(statement, block)
        if self.loops:
            self.jump(block, self.loops[-1][0], "continue", self.loops[-1][2])

    def on_Return(self, statement, block):
        self.put(statement, block)
        self.jump(block, EXIT, "return")

    def on_Raise(self, statement, block):
        self.put(statement, block)
        if not self.catchers:
            self.jump(block, EXIT, "raise")

    def on_With(self, statement, block):
        self.put(statement, block)
        return self.run(statement.body, block)

    on_AsyncWith = on_With

    def on_Match(self, statement, block):
        self.put(statement, block)
        ends = [self.run(case.body, self.follow(block, "case")) for case in statement.cases]
        last = statement.cases[-1]
        if last.guard is None and isinstance(last.pattern, ast.MatchAs) and last.pattern.pattern is None:
            return self.join(ends, ["next"] * len(ends))
        return self.join([*ends, block], ["next"] * len(ends) + ["false"])

    def on_Try(self, statement, block):
        final = (self.graph.new(), {}) if statement.finalbody else None
        if final:
            self.finals.append(final)
        handlers = [self.graph.new() for _ in statement.handlers]
        outside = self.catchers[-1] if self.catchers else None
        # What no handler takes goes to the finally; without one, outward as if there were no try.
        bare = any(h.type is None for h in statement.handlers)
        escape = [final[0]] if final else (outside or [])
        self.catchers.append(handlers + ([] if bare else escape if handlers else escape or [EXIT]))
        end = self.run(statement.body, self.follow(block))
        self.catchers.pop()
        if final:
            self.catchers.append(escape)
        end = self.run(statement.orelse, end) if statement.orelse and end is not None else end
        ends = [end, *(self.run(h.body, entry) for h, entry in zip(statement.handlers, handlers))]
        if not final:
            return self.join(ends, ["next"] * len(ends))
        self.catchers.pop()
        self.finals.pop()
        entry, onward = final
        for e in ends:
            self.graph.link(e, entry, "finally")
        raised = any(b == entry and kind == "raise" for (_, b), kind in self.graph.edges.items())
        last = self.run(statement.finalbody, entry)
        if last is None:
            return None
        for target, kind in onward.items():
            self.graph.link(last, target, kind)
        if raised:
            for target in outside or [EXIT]:
                self.graph.link(last, target, "raise")
        return self.follow(last) if any(e is not None for e in ends) else None

    on_TryStar = on_Try


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return ""


def _own(statement: ast.stmt):
    """Expressions of the statement itself: not of the statements it holds, nor of inner functions."""
    stack = [c for c in ast.iter_child_nodes(statement) if not isinstance(c, (ast.stmt, ast.ExceptHandler, ast.match_case))]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.stmt, *_SCOPES)))


def _names(target: ast.AST) -> list[str]:
    return [n.id for n in ast.walk(target) if isinstance(n, ast.Name)]


def _defined(statement: ast.stmt) -> dict[str, ast.expr | None]:
    """Variables that the statement sets, with their value where it is one expression."""
    out: dict[str, ast.expr | None] = {}
    if isinstance(statement, ast.Assign):
        for target in statement.targets:
            for name in _names(target) if not isinstance(target, (ast.Attribute, ast.Subscript)) else []:
                out[name] = statement.value if isinstance(target, ast.Name) else None
    elif isinstance(statement, ast.AnnAssign) and isinstance(statement.target, ast.Name) and statement.value is not None:
        out[statement.target.id] = statement.value
    elif isinstance(statement, ast.AugAssign) and isinstance(statement.target, ast.Name):
        grown = ast.BinOp(ast.Name(statement.target.id), statement.op, statement.value)
        out[statement.target.id] = ast.copy_location(grown, statement)
    elif isinstance(statement, (ast.For, ast.AsyncFor)):
        out |= dict.fromkeys(_names(statement.target))
    elif isinstance(statement, (ast.With, ast.AsyncWith)):
        for item in statement.items:
            out |= dict.fromkeys(_names(item.optional_vars) if item.optional_vars else [])
    for node in _own(statement):
        if isinstance(node, ast.NamedExpr):
            out[node.target.id] = node.value
    return out


def _is_text(node: ast.AST) -> bool:
    return isinstance(node, ast.JoinedStr) or isinstance(node, ast.Constant) and isinstance(node.value, str)


def _is_fixed(node: ast.AST) -> bool:
    """Made of constants alone."""
    return all(isinstance(n, (ast.Constant, ast.JoinedStr, ast.BinOp, ast.operator, ast.Tuple, ast.expr_context)) for n in ast.walk(node))


def _is_built(node: ast.expr) -> bool:
    """A string put together from fixed text and something else."""
    if isinstance(node, ast.JoinedStr):
        return any(isinstance(v, ast.FormattedValue) for v in node.values)
    if isinstance(node, ast.Call):
        return isinstance(node.func, ast.Attribute) and node.func.attr == "format" and _is_text(node.func.value) and bool(node.args or node.keywords)
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Mod, ast.Add)):
        parts = [n for n in ast.walk(node) if _is_text(n)]
        return bool(parts) and not _is_fixed(node)
    return False


def _fixpoint(graph: Graph, start: frozenset, through, raising=None) -> list[frozenset | None]:
    """What may hold before each block: the union over its ways in, None where nothing leads."""
    before: list[frozenset | None] = [None] * len(graph.blocks)
    before[ENTRY] = start
    work, after = [ENTRY], graph.targets()
    while work:
        block = work.pop()
        normal = through(block, before[block])
        for target in after[block]:
            value = raising(block, before[block]) if raising and graph.edges[block, target] == "raise" else normal
            if before[target] is None or not value <= before[target]:
                before[target] = value | (before[target] or frozenset())
                work.append(target)
    return before


def _flows(graph: Graph, parameters: list[str]) -> list[tuple[str, str, int, int]]:
    """Calls that run a string built at the call or at a definition that reaches it, also through copies."""
    made = {}  # (block, place, name): value

    def define(state: frozenset, block: int, place: int, statement: ast.stmt) -> frozenset:
        new = _defined(statement)
        for name, value in new.items():
            made[block, place, name] = value
        return frozenset(d for d in state if d[2] not in new) | {(block, place, name) for name in new}

    def through(block, state):
        for place, statement in enumerate(graph.blocks[block]):
            state = define(state, block, place, statement)
        return state

    def trait(node, at):
        """Whether an operand may be text, and whether it is sure to be made of constants alone."""
        held = [made.get(d) for d in states.get(at, ()) if d[2] == node.id] if isinstance(node, ast.Name) else [node]
        return any(v is not None and (_is_text(v) or _is_built(v)) for v in held), bool(held) and all(v is not None and _is_fixed(v) for v in held)

    def sources(value, at, seen):
        """Lines where what this expression holds was built."""
        if value is None:
            return set()
        if isinstance(value, ast.Name):
            out = set()
            for d in states.get(at, ()):
                if d[2] == value.id and d not in seen:
                    seen.add(d)
                    out |= sources(made.get(d), d[:2], seen)
            return out
        if _is_built(value):
            return {value.lineno}
        if isinstance(value, ast.BinOp) and isinstance(value.op, (ast.Add, ast.Mod)):
            traits = [trait(n, at) for n in (value.left, value.right)]
            if any(text for text, _ in traits) and not all(fixed for _, fixed in traits):
                return {value.lineno}
            return set().union(*(sources(n, at, seen) for n in (value.left, value.right) if isinstance(n, ast.Name)))
        if isinstance(value, ast.IfExp):
            return sources(value.body, at, seen) | sources(value.orelse, at, seen)
        return set()

    start = frozenset((-1, 0, name) for name in parameters)
    before = _fixpoint(graph, start, through)
    states = {}  # definitions that reach each statement
    for block, state in enumerate(before):
        for place, statement in enumerate(graph.blocks[block] if state is not None else ()):
            states[block, place] = state
            state = define(state, block, place, statement)
    found = set()
    for at in states:
        for node in _own(graph.blocks[at[0]][at[1]]):
            if not isinstance(node, ast.Call) or not node.args:
                continue
            kind = SINKS.get(_dotted(node.func)) or SINKS.get(node.func.attr if isinstance(node.func, ast.Attribute) else "")
            if kind:
                first = node.args[0]
                variable = first.id if isinstance(first, ast.Name) else ""
                found |= {(kind, variable, line, node.lineno) for line in sources(first, at, set())}
    return sorted(found)


def _leaks(graph: Graph) -> list[tuple[int, str]]:
    """Handles opened outside ``with`` that some way to the end leaves open.

    A handle that is returned, yielded, stored or given to a call belongs to someone else; one whose variable is set
    anew, or that was never bound, is lost.
    """

    def opened(node) -> bool:
        return isinstance(node, ast.Call) and _dotted(node.func) in OPENERS

    def released(statement: ast.stmt) -> set[str]:
        out = set()
        value = getattr(statement, "value", None)
        if isinstance(statement, (ast.Return, ast.Assign, ast.AnnAssign)) and value is not None:
            out |= {n.id for n in ([value] if isinstance(value, ast.Name) else value.elts if isinstance(value, (ast.Tuple, ast.List)) else []) if isinstance(n, ast.Name)}
        if isinstance(statement, (ast.With, ast.AsyncWith)):
            out |= {n for item in statement.items for n in _names(item.context_expr)}
        for node in _own(statement):
            if isinstance(node, ast.Call):
                out |= {a.id for a in [*node.args, *(k.value for k in node.keywords)] if isinstance(a, ast.Name)}
                if isinstance(node.func, ast.Attribute) and node.func.attr == "close" and isinstance(node.func.value, ast.Name):
                    out.add(node.func.value.id)
            if isinstance(node, (ast.Yield, ast.YieldFrom)) and isinstance(node.value, ast.Name):
                out.add(node.value.id)
        return out

    def gained(statement: ast.stmt) -> set[tuple[int, str]]:
        new = {(v.lineno, name) for name, v in _defined(statement).items() if v is not None and opened(v)}
        for node in _own(statement):
            if isinstance(node, ast.Attribute) and opened(node.value):
                new.add((node.value.lineno, ""))  # open(p).read()
        return new | ({(statement.value.lineno, "")} if isinstance(statement, ast.Expr) and opened(statement.value) else set())

    def close(state, statement):
        gone = released(statement)
        return frozenset(s for s in state if s[1] not in gone)

    def through(block, state):
        for statement in graph.blocks[block]:
            state = close(state, statement)
            set_ = _defined(statement)
            state = frozenset((line, "" if name in set_ else name) for line, name in state) | gained(statement)
        return state

    def raising(block, state):
        # What raises has not opened anything yet; a close counts as done.
        for statement in graph.blocks[block]:
            state = close(state, statement)
        return state

    left = _fixpoint(graph, frozenset(), through, raising)[EXIT] or frozenset()
    names = {v.lineno: name for b in graph.blocks for s in b for name, v in _defined(s).items() if v is not None and opened(v)}
    return sorted({(line, names.get(line, "")) for line, _ in left})


def _functions(tree: ast.Module):
    yield "<module>", 1, tree.body, []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            given = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x]
            yield node.name, node.lineno, node.body, given


def analyse(code: str) -> list[dict]:
    """All functions of a file; none if it does not parse."""
    try:
        tree = ast.parse(code)
        out = []
        for name, line, body, given in _functions(tree):
            graph = _Builder(body).graph
            near = graph.dominators()
            blocks = [
                {
                    "block": i, "first_line": min((s.lineno for s in b), default=None), "last_line": max((s.lineno for s in b), default=None),
                    "statements": len(b), "dominator": near[i] if i != ENTRY else None, "reachable": near[i] is not None,
                }
                for i, b in enumerate(graph.blocks)
            ]
            edges = [{"source": a, "target": b, "kind": kind} for (a, b), kind in sorted(graph.edges.items())]
            flows = [dict(zip(("kind", "variable", "source_line", "sink_line"), f)) for f in _flows(graph, given)]
            leaks = [dict(zip(("line", "variable"), x)) for x in _leaks(graph)]
            out.append({"function": name, "line": line, "blocks": blocks, "edges": edges, "flows": flows, "leaks": leaks})
        return out
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


@functools.cache
def _flow_udf():
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T._parse_datatype_string(FUNCTION))

    def run(codes: pa.Array) -> pa.Array:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return pa.array([analyse(code.as_py() or "") for code in codes], kind)

    return F.arrow_udf(run, FUNCTION).asNondeterministic()


def with_flow(files: DataFrame) -> DataFrame:
    """Add ``flow``: the functions of each file (empty if it does not parse; a null text is an empty one)."""
    return files.withColumn("flow", _flow_udf()(F.col("code")))


def _unrolled(files: DataFrame, part: str) -> DataFrame:
    functions = with_flow(files).select("file_id", F.posexplode("flow").alias("function_no", "f"))
    return functions.select("file_id", "function_no", F.col("f.function").alias("function"), F.inline(f"f.{part}"))


def cfg_blocks(files: DataFrame) -> DataFrame:
    """``file_id, function_no, function, block, first_line, last_line, statements, dominator, reachable``."""
    return _unrolled(files, "blocks")


def cfg_edges(files: DataFrame) -> DataFrame:
    """``file_id, function_no, function, source, target, kind``."""
    return _unrolled(files, "edges")


def cfg_functions(files: DataFrame) -> DataFrame:
    """Blocks, edges, cyclomatic number (edges - blocks + 2 over what the entry reaches) and unreachable blocks."""
    functions = with_flow(files).select("file_id", F.posexplode("flow").alias("function_no", "f"))
    live = F.filter("f.blocks", lambda b: b["reachable"])
    ids = F.transform(live, lambda b: b["block"])
    edges = F.filter("f.edges", lambda e: F.array_contains(ids, e["source"]))
    # The end counts as reached, also of an endless function.
    nodes = F.size(F.array_union(ids, F.array(F.lit(EXIT))))
    dead = F.filter("f.blocks", lambda b: ~b["reachable"] & (b["statements"] > 0))
    return functions.select(
        "file_id", "function_no", F.col("f.function").alias("function"), F.col("f.line").alias("line"),
        nodes.alias("n_blocks"), F.size(edges).alias("n_edges"), (F.size(edges) - nodes + 2).alias("complexity"),
        F.transform(dead, lambda b: b["first_line"]).alias("unreachable_lines"),
    )


def flow_findings(files: DataFrame) -> DataFrame:
    """``file_id, function, kind, variable, source_line, sink_line``: built strings that reach a call which runs them."""
    return _unrolled(files, "flows").drop("function_no")


def resource_findings(files: DataFrame) -> DataFrame:
    """``file_id, function, line, variable``: handles opened outside ``with`` and not closed on every way out."""
    return _unrolled(files, "leaks").drop("function_no")
