"""The labelled code relation that every code query reads.

The supplied tables hold prose, so a file is built per document: a context, a statement
template and the document's whole text as trailing comment lines.  Templates are picked by
the file id, so the relation grows with ``documents`` and needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.pystr import PY_SPACE, literal_map
from riskweave.session import spread

# The contexts and templates of the test relation, in index order.
CONTEXTS = (
    "import os\n",
    "def run(data):\n    ",
    "if ready:\n    ",
    "class Job:\n    def start(self):\n        ",
    "# header\n",
    "async def go():\n    ",
)
TEMPLATES = (
    ("hardcoded_password", "password = 'hunter2'"),
    ("hardcoded_password", 'db_password="pa55"'),
    ("hardcoded_password", "pwd = 'letmein'"),
    ("hardcoded_password", "if password == 'open': allowed = True"),
    ("eval_usage", "total = eval(expr)"),
    ("eval_usage", "model.eval()"),
    ("eval_usage", "exec(source)"),
    ("eval_usage", "obj = compile(src, 'f', 'exec')"),
    ("sql_injection", 'cur.execute("select * from t where id = %s" % uid)'),
    ("sql_injection", "cur.execute(\"select 1 where a like '%x'\")"),
    ("sql_injection", 'cur.execute("select * from t where id = ?", (uid,))'),
    ("sql_injection", "q = 'select * from t where id = ' + uid"),
    ("shell_injection", "os.system('ls ' + d)"),
    ("shell_injection", "subprocess.call(cmd)"),
    ("shell_injection", "subprocess.run(cmd, check=True)"),
    ("shell_injection", "name = input('name: ')"),
    ("weak_crypto", "h = hashlib.md5(blob).hexdigest()"),
    ("weak_crypto", "h = SHA1(blob)"),
    ("weak_crypto", "h = hashlib.sha256(blob)"),
    ("weak_crypto", "note = 'api_key=\"abc123\"'"),
    ("insecure_random", "r = random.random()"),
    ("insecure_random", "r = random.randint(1, 6)"),
    ("insecure_random", "r = random.choice(xs)"),
    ("insecure_random", "r = secrets.randbelow(6)"),
    ("exception_handling", "try: work()\nexcept: pass"),
    ("exception_handling", "try:\n        work()\n    except:\n        pass"),
    ("exception_handling", "try: work()\nexcept ValueError: pass"),
    ("exception_handling", "with open(p) as f: data = f.read()"),
    ("safe", "def add(a, b): return a + b"),
    ("safe", "class Box: pass"),
    ("safe", "for i in range(3): print(i)"),
    ("safe", "while busy: step()"),
    ("safe", "ok = a and b or c"),
    ("safe", "x = a * b + c ** 2"),
    ("safe", 'def doc():\n        """One line."""\n        return 1'),
    ("safe", "s = f'{a}-{b}'"),
    ("broken", "def broken(:"),
)
# Severity by type, with its default for every other type.
SEVERITY_BY_TYPE = {
    "hardcoded_password": "critical",
    "eval_usage": "high",
    "sql_injection": "critical",
    "shell_injection": "high",
    "weak_crypto": "medium",
    "insecure_random": "medium",
    "exception_handling": "low",
    "safe": "info",
}
DEFAULT_SEVERITY = "medium"


def combine(context: Column, template: Column, indent_all: bool = False) -> Column:
    """Context then template, indented when the context ends with a colon."""
    opens_block = F.endswith(F.rtrim(context, F.lit(PY_SPACE)), F.lit(":"))
    body = F.replace(template, F.lit("\n"), F.lit("\n    ")) if indent_all else template
    return F.when(opens_block, F.concat(context, F.lit("\n    "), body)).otherwise(
        F.concat(context, F.lit("\n"), template)
    )


def code_corpus(documents: DataFrame, copies: int = 1) -> DataFrame:
    """Files from documents: ``file_id, file_path, code, template_type, severity, source``.

    ``copies`` repeats every document under new ids, for larger trial runs.
    """
    files = documents.select("doc_id", "source", "text")
    if copies > 1:
        files = files.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        files = files.withColumn("file_id", F.col("doc_id") * copies + F.col("copy"))
    else:
        files = files.withColumn("file_id", F.col("doc_id"))
    n_templates, n_contexts = len(TEMPLATES), len(CONTEXTS)
    t = (F.col("file_id") % n_templates).cast("int")
    c = (F.floor(F.col("file_id") / n_templates) % n_contexts).cast("int")
    files = (
        files.withColumn("template", F.get(F.array(*[F.lit(b) for _, b in TEMPLATES]), t))
        .withColumn("template_type", F.get(F.array(*[F.lit(k) for k, _ in TEMPLATES]), t))
        .withColumn("context", F.get(F.array(*[F.lit(b) for b in CONTEXTS]), c))
    )
    tail = F.concat(F.lit("\n# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))
    return files.select(
        "file_id",
        F.concat(
            F.lit("src/"), F.col("source"), F.lit("/f"), F.col("file_id"), F.lit(".py")
        ).alias("file_path"),
        F.concat(combine(F.col("context"), F.col("template")), tail).alias("code"),
        "template_type",
        literal_map(SEVERITY_BY_TYPE, F.col("template_type"), DEFAULT_SEVERITY).alias("severity"),
        "source",
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus_table(spark: SparkSession, folder: str, copies: int = 1) -> DataFrame:
    """``code_corpus`` over the supplied documents, spread over the cores before any parsing."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    return code_corpus(spread(documents, "doc_id"), copies)
