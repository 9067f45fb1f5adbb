"""Reports and programs made from rows of the tables, so that queries over them grow with the tables and SQL over the same rows says what must come out."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.plans.state import folder


def sarif_reports(lineitem: DataFrame) -> DataFrame:
    """A SARIF document for each supplier: a rule per return flag, a result per line of an order, some with a flow, a base id, a level or a broken location."""
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("int")
    location = lambda uri, line: F.named_struct(F.lit("physicalLocation"), F.named_struct(F.lit("artifactLocation"), F.named_struct(F.lit("uri"), uri, F.lit("uriBaseId"), F.when(F.col("l_linestatus") == "F", "SRC")), F.lit("region"), F.named_struct(F.lit("startLine"), line)))
    uri = F.concat(F.lit("./part%20"), F.col("l_partkey").cast("string"), F.lit(".py"))
    step = lambda line: F.named_struct(F.lit("location"), location(uri, line))
    flows = F.when(n >= 5, F.array(F.named_struct(F.lit("threadFlows"), F.array(F.named_struct(F.lit("locations"), F.array(step(n - 1), step(n)))))))
    result = F.to_json(F.named_struct(
        F.lit("ruleId"), F.concat(F.lit("rule/"), "l_returnflag"), F.lit("level"), F.when(n == 1, "note"), F.lit("message"), F.named_struct(F.lit("text"), F.concat(F.lit("order "), k)),
        F.lit("locations"), F.array(location(uri, n)), F.lit("codeFlows"), flows,
    ))
    # A location that is a text, in place of an object.
    result = F.when(n == 3, F.concat(F.lit('{"ruleId":"rule/'), "l_returnflag", F.lit('","locations":["oops"]}'))).otherwise(result)
    rules = ",".join(f'{{"id":"rule/{x}","defaultConfiguration":{{"level":"{level}"}},"properties":{{"security-severity":"{score}","tags":["external/cwe/cwe-0{cwe}"]}}}}' for x, level, score, cwe in (("A", "error", "9.1", 89), ("N", "warning", "5.0", 79), ("R", "note", "2.5", 22)))
    # Lines are dealt to their suppliers before they are made longer.
    dealt = lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").repartition("l_suppkey")
    g = dealt.select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", result.alias("json")).alias("r")).groupBy("l_suppkey").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    body = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"Gen","version":"3","rules":['), F.lit(rules), F.lit(']}},"originalUriBaseIds":{"SRC":{"uri":"file:///work/","uriBaseId":"TOP"},"TOP":{"uri":"/top"}},"results":['), F.array_join(F.transform("rs", lambda x: x["json"]), ","), F.lit("]}]}"))
    return g.select(F.col("l_suppkey").cast("long").alias("doc"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"), F.lit("sarif").alias("kind"), body.alias("content"))


SARIF_SQL = """
SELECT l_suppkey AS doc, l_orderkey AS item, CASE WHEN bad THEN 'parse-error' END AS problem, CASE WHEN NOT bad THEN 'rule/' || l_returnflag END AS rule_id, CASE WHEN NOT bad THEN './part%20' || l_partkey || '.py' END AS uri,
       CASE WHEN NOT bad THEN CASE WHEN l_linestatus = 'F' THEN '/work/' ELSE '' END END AS base, CASE WHEN NOT bad THEN l_linenumber END AS line, CASE WHEN l_linenumber >= 5 THEN 2 ELSE 0 END AS steps,
       CASE WHEN l_linenumber = 1 THEN 'note' ELSE CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'warning' ELSE 'note' END END AS level,
       CASE l_returnflag WHEN 'A' THEN '9.1' WHEN 'N' THEN '5.0' ELSE '2.5' END AS score, CASE WHEN NOT bad THEN 'external/cwe/cwe-0' || CASE l_returnflag WHEN 'A' THEN '89' WHEN 'N' THEN '79' ELSE '22' END || ',rule/' || l_returnflag ELSE '' END AS cwe, count(*) AS n
FROM (SELECT *, l_linenumber = 3 AS bad FROM lineitem) GROUP BY ALL
"""


def semgrep_reports(events: DataFrame) -> DataFrame:
    """A Semgrep document for each user, a result per event: clicks have a trace in nested calls, views one in steps, errors a mistyped part."""
    i, k = F.col("event_id").cast("string"), F.col("event_type")
    at = lambda line: F.concat(F.lit('{"path":"'), k, F.lit('.py","start":{"line":'), line.cast("string"), F.lit("}}"))
    source = F.when(k == "click", F.concat(F.lit('["CliCall",[["CliLoc",['), at(F.col("user_id")), F.lit(',"said '), i, F.lit('"]],[],null]]'))).when(k == "view", F.concat(F.lit('{"location":'), at(F.col("user_id")), F.lit(',"content":"seen"}')))
    steps = F.when(k == "view", F.concat(F.lit('[{"location":'), at(F.col("user_id") + 1), F.lit("},7]"))).otherwise("[]")
    trace = F.when(source.isNotNull(), F.concat(F.lit(',"dataflow_trace":{"taint_source":'), source, F.lit(',"intermediate_vars":'), steps, F.lit("}"))).otherwise("")
    extra = F.when(k == "error", F.lit('"extra":5')).otherwise(F.concat(F.lit('"extra":{"severity":"WARNING","message":"m '), i, F.lit('","metadata":{"cwe":"CWE-7: x","confidence":"HIGH"}'), trace, F.lit("}")))
    row = F.concat(F.lit('{"check_id":"gen.'), k, F.lit('","path":"'), k, F.lit('.py","start":{"line":'), i, F.lit("},"), extra, F.lit("}"))
    g = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", row.alias("json")))).alias("rs"))
    return g.select(F.col("user_id").cast("long").alias("doc"), F.lit("u").alias("path"), F.lit("semgrep").alias("kind"), F.concat(F.lit('{"results":['), F.array_join(F.transform("rs", lambda x: x["json"]), ","), F.lit("]}")).alias("content"))


SEMGREP_SQL = """
SELECT user_id AS doc, CASE WHEN event_type <> 'error' THEN event_id END AS line, CASE WHEN event_type = 'error' THEN 'parse-error' END AS problem, CASE WHEN event_type <> 'error' THEN 'gen.' || event_type END AS rule_id,
       CASE event_type WHEN 'click' THEN 'click.py:' || user_id || ' said ' || event_id WHEN 'view' THEN 'view.py:' || user_id || ' seen,view.py:' || (user_id + 1) || ' ' ELSE '' END AS flow,
       CASE WHEN event_type <> 'error' THEN 'CWE-7: x,gen.' || event_type ELSE '' END AS cwe, CASE WHEN event_type <> 'error' THEN 'm ' || event_id END AS message, count(*) AS n FROM events GROUP BY ALL
"""

#: Lines of a module before its functions, and of each function and each handler.
HEAD, FUNCTION, HANDLER = 4, 5, 5


def modules(customer: DataFrame) -> DataFrame:
    """path, part, content: a module for each nation, in parts by their order. Each customer is a function that passes its argument on to customer k // 2's, which lies in another module as a rule, and a handler that calls it with a request.

    Customers of the segment BUILDING execute the argument, those of MACHINERY make it a number first. Handlers of customers in debt ask for an administrator.
    """
    nation = customer.select(F.col("c_custkey").alias("up"), F.col("c_nationkey").alias("up_nation"))
    c = customer.withColumn("up", F.floor(F.col("c_custkey") / 2)).join(nation, "up")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    k, sink = F.col("c_custkey"), F.col("c_mktsegment") == "BUILDING"
    first = F.when(F.col("c_mktsegment") == "MACHINERY", "y = int(x)").otherwise("y = x")
    on = F.when(sink, "db.execute(y)").when(k == 0, "pass").when(F.col("up_nation") == F.col("c_nationkey"), text("f", F.col("up"), "(db, y)")).otherwise(text("m", F.col("up_nation"), ".f", F.col("up"), "(db, y)"))
    function = text("def f", k, "(db, x):\n    ", first, "\n    ", on, "\n    return None\n\n")
    handler = text("def h", k, '(db):\n    q = request.args["q"]\n    if ', F.when(F.col("c_acctbal") < 0, "current_user.is_admin").otherwise("q"), ":\n        f", k, "(db, q)\n\n")
    # No row holds a module: its parts are its head, the functions and the handlers, in the order of customers.
    each = F.explode(F.array(F.struct(F.lit(1).alias("section"), function.alias("text")), F.struct(F.lit(2).alias("section"), handler.alias("text"))))
    parts = c.select("c_nationkey", k.alias("k"), each.alias("x")).select("c_nationkey", F.struct("x.section", "k", "x.text").alias("part"))
    every = c.agg(F.array_join(F.transform(F.array_sort(F.collect_set("c_nationkey")), lambda n: F.concat(F.lit("m"), n.cast("string"))), ", ").alias("imports"))  # one row
    head = text("from flask import request\nfrom flask_login import current_user\nimport ", F.col("imports"), "\n\n")
    heads = c.select("c_nationkey").distinct().crossJoin(every).select("c_nationkey", F.struct(F.lit(0).alias("section"), F.lit(None).cast(customer.schema["c_custkey"].dataType).alias("k"), head.alias("text")).alias("part"))
    return heads.union(parts).where("part.text is not null").select(text("m", F.col("c_nationkey"), ".py").alias("path"), F.struct("part.section", "part.k").alias("part"), F.col("part.text").cast("binary").alias("content"))


PROGRAM_SQL = f"""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer),
way AS (SELECT c_custkey AS start, c_custkey AS k FROM customer
        UNION ALL SELECT start, k // 2 FROM way JOIN customer ON c_custkey = k WHERE k > 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))
SELECT 'm' || s.c_nationkey || '.py' AS source_file, {HEAD} + {FUNCTION} * s.size + {HANDLER} * s.i + 2 AS source_line, 'h' || start AS function, 'm' || e.c_nationkey || '.py' AS sink_file, {HEAD} + {FUNCTION} * e.i + 3 AS sink_line,
       CASE WHEN s.c_acctbal < 0 THEN 'is_admin' ELSE '' END AS guards, s.c_acctbal >= 0 AS unguarded, 'flask-request-input' AS source_id, 'py-sql-exec' AS sink_id
FROM way JOIN p s ON s.c_custkey = start JOIN p e ON e.c_custkey = k WHERE e.c_mktsegment = 'BUILDING'
"""


def write_tree(files: DataFrame) -> str:
    """files: path, part, content. The parts of a path, in their order, are written as a file under a new folder of the shared one; its URI."""
    root = f"{folder(files.sparkSession)}/tree-{uuid.uuid4().hex}"

    def run(batches):
        store, base = fs.FileSystem.from_uri(root)
        path, out = None, None
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None or name != path:
                    if out is not None:
                        out.close()
                    path, at = name, f"{base}/{name}"
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(at, compression=None, buffer_size=1 << 20)
                out.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})
        if out is not None:
            out.close()

    files.repartition("path").sortWithinPartitions("path", "part", "content").select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return root
