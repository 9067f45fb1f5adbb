"""A small project and reports about it, for queries and tests of the product paths."""

from __future__ import annotations

import json

PROJECT = {
    "shop/web.py": '''from flask import request
from flask_login import current_user, login_required
from .store import find_items, Basket

LIMIT = "ten"


def search():
    term = request.args["q"]
    return find_items(term)


def by_number():
    n = int(request.args["n"])
    return find_items(n)


@login_required
def private():
    return find_items(request.form["note"])


def admin(cur):
    if not current_user.is_admin:
        return None
    cur.execute(request.values["sql"])


def either(cur, cached):
    if current_user.is_admin or cached:
        cur.execute(request.values["sql"])


def put():
    b = Basket(request.json)
    return b.save(LIMIT)
''',
    "shop/store.py": '''import os
import sqlite3


class Basket:
    def __init__(self, rows):
        self.rows = rows

    def save(self, limit):
        return query("insert " + limit)


def find_items(text):
    sql = f"select * from items where name like {text}"
    return query(sql)


def query(sql):
    con = sqlite3.connect("shop.db")
    return con.execute(sql)


def clean(name, password):
    while name:
        name = name[1:]
        if name == "x":
            break
    os.system("rm " + password)
''',
    "shop/__init__.py": "",
    "web/app.js": "const q = location.search; // nothing here is Python\n",
}


def _at(uri: str, line, **more) -> dict:
    return {"physicalLocation": {"artifactLocation": {"uri": uri, **more}, "region": {"startLine": line}}}


def _flow(*places) -> list:
    return [{"threadFlows": [{"locations": [{"location": p} for p in places]}]}]


SARIF = {
    "version": "2.1.0",
    "runs": [
        {
            "tool": {"driver": {"name": "Lens", "semanticVersion": "2.0", "rules": [{"id": "py/sql-injection", "defaultConfiguration": {"level": "error"}, "properties": {"tags": ["external/cwe/cwe-089"], "security-severity": "9.3", "precision": "high"}}]}},
            "originalUriBaseIds": {"SRC": {"uri": "file:///work/shop-project/"}},
            "results": [
                {"ruleId": "py/sql-injection", "message": {"text": "Query built from input."}, "locations": [_at("shop/store.py", 20, uriBaseId="SRC")], "codeFlows": _flow(_at("shop/web.py", 9), _at("elsewhere/shop/store.py", 15), _at("shop/store.py", 20)) * 2},
                {"ruleId": "py/sql-injection", "message": {"text": "Query built from input."}, "locations": [_at("shop/web.py", 26)]},
                {"ruleId": "js/xss", "level": "warning", "locations": [_at("web/app.js", 1)]},
                {"ruleId": "py/lost", "locations": [_at("../../etc/passwd", 1)]},
                {"ruleId": "py/bad", "locations": ["oops"]},
            ],
        },
        {"tool": {"driver": {"name": "Second"}}, "results": [{"ruleId": "py/sql-injection", "locations": [_at("shop/web.py", "26")]}]},
    ],
}
SEMGREP = {
    "results": [
        {
            "check_id": "python.flask.sql", "path": "shop/store.py", "start": {"line": 20}, "end": {"line": 20},
            "extra": {
                "severity": "ERROR", "message": "tainted query", "lines": "    return con.execute(sql)", "metadata": {"cwe": ["CWE-89: SQL injection"], "confidence": "HIGH"},
                "dataflow_trace": {"taint_source": ["CliLoc", [{"path": "shop/web.py", "start": {"line": 9}}, 'request.args["q"]']], "intermediate_vars": [{"location": {"path": "shop/web.py", "start": {"line": 9}}, "content": "term"}]},
            },
        },
        {"check_id": "python.os.system", "path": "shop/store.py", "start": {"line": 28}, "extra": {"severity": "WARNING", "metadata": {}}},
        7,
    ]
}


def tree(spark):
    return spark.createDataFrame([(k, v.encode()) for k, v in PROJECT.items()], "path string, content binary")


def reports(spark):
    return spark.createDataFrame([(0, "lens.sarif", "sarif", json.dumps(SARIF)), (1, "semgrep.json", "semgrep", json.dumps(SEMGREP))], "doc long, path string, kind string, content string")
