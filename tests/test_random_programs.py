"""Taint of random functions against a small interpreter of their structure, written for this test alone."""

import random

from ferrule.operators.lowering import lower_files
from ferrule.plans.state import kept
from ferrule.plans.taint import Analysis
from ferrule.sources.rules import default_rules

NAMES = "abcd"


class Program:
    """Random source together with what reaches its sinks."""

    def __init__(self, seed: int):
        self.r, self.lines, self.found = random.Random(seed), ["from flask import request"], set()

    def function(self, name: str) -> None:
        self.lines.append(f"def {name}(db, t):")
        tree = [self.statement(1, 3) for _ in range(self.r.randint(3, 8))]
        self.run(tree, {})

    def statement(self, depth: int, deeper: int):
        r, pad = self.r, "    " * depth
        kind = r.choice(["source", "copy", "both", "clean", "int", "sink", "sink", "if", "while", "for"] if deeper else ["source", "copy", "both", "clean", "sink"])
        x, y, z = (r.choice(NAMES) for _ in range(3))
        text = {"source": f"{x} = request.data", "copy": f"{x} = {y}", "both": f"{x} = [{y}, f'{{{z}}}']", "clean": f"{x} = 'k'", "int": f"{x} = int({y})", "sink": f"db.execute({x})", "if": "if t:", "while": "while t:", "for": f"for {x} in {y}:"}[kind]
        self.lines.append(pad + text)
        line = len(self.lines)
        if kind not in ("if", "while", "for"):
            return kind, line, x, y, z, None, None
        body = [self.statement(depth + 1, deeper - 1) for _ in range(r.randint(1, 3))]
        other = None
        if kind == "if" and r.random() < 0.5:
            self.lines.append(pad + "else:")
            other = [self.statement(depth + 1, deeper - 1) for _ in range(r.randint(1, 3))]
        return kind, line, x, y, z, body, other

    @staticmethod
    def join(a: dict, b: dict) -> dict:
        return {k: a.get(k, frozenset()) | b.get(k, frozenset()) for k in a.keys() | b.keys()}

    def run(self, tree, state: dict) -> dict:
        for kind, line, x, y, z, body, other in tree:
            of = lambda v: state.get(v, frozenset())  # noqa: B023, E731
            if kind == "sink":
                self.found |= {(s, line) for s in of(x)}
            elif kind == "if":
                state = self.join(self.run(body, dict(state)), self.run(other or [], dict(state)))
            elif kind in ("while", "for"):
                while True:
                    inside = dict(state) | ({x: state.get(y, frozenset())} if kind == "for" else {})
                    after = self.join(state, self.run(body, inside))
                    if kind == "for":
                        after = self.join(after, inside)
                    if after == state:
                        break
                    state = after
                if kind == "for":
                    # The loop's own target is set at its head, on the way out as well.
                    state = dict(state) | {x: state.get(y, frozenset())}
            else:
                state = dict(state) | {x: {"source": frozenset({line}), "copy": of(y), "both": of(y) | of(z), "clean": frozenset(), "int": frozenset()}[kind]}
        return state


def test_random_functions(spark):
    programs = {f"p{i}.py": Program(i) for i in range(12)}
    for p in programs.values():
        for k in range(12):
            p.function(f"f{k}")
    files = spark.createDataFrame([(n, "\n".join(p.lines).encode()) for n, p in programs.items()], "path string, content binary")
    found = {}
    for r in Analysis(kept(lower_files(files), "low"), default_rules()).findings.collect():
        found.setdefault(r.source_file, set()).add((r.source_line, r.sink_line))
    assert sum(len(p.found) for p in programs.values()) > 40
    for n, p in programs.items():
        assert found.get(n, set()) == p.found, "\n".join(f"{i + 1}: {x}" for i, x in enumerate(p.lines))
