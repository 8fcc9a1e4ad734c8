"""Synthetic labelled samples: templates in contexts, chosen by hash of the sample id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.pystr import hash_bits, hash_unit, literal_map, py_strip, split_lines
from riskweave.operators.ranks import shuffled_rank
from riskweave.sources.corpus import DEFAULT_SEVERITY, SEVERITY_BY_TYPE, combine

# Sample descriptions and confidence ranges.
DESCRIPTION_BY_TYPE = {
    "hardcoded_password": "Hardcoded password detected in source code",
    "eval_usage": "Use of eval() function can lead to code injection",
    "sql_injection": "Potential SQL injection vulnerability",
    "shell_injection": "Potential shell injection vulnerability",
    "weak_crypto": "Use of weak cryptographic hash function",
    "insecure_random": "Use of insecure random number generation",
    "exception_handling": "Bare except clause detected",
}
DEFAULT_DESCRIPTION = "Security vulnerability detected"
VULNERABLE_CONFIDENCE = (0.7, 1.0)
SAFE_CONFIDENCE = (0.8, 1.0)

# This library's own statements.  Each vulnerable one is what its type says, and the scan finds it;
# the scan finds nothing in the safe ones.  Every context takes statements of any number of lines.
CONTEXTS = (
    "import os\nimport sys\n",
    "def handle(request):\n    ",
    "if ready:\n    ",
    "async def worker():\n    ",
    "# generated\n",
    "while pending:\n    ",
    "class Settings:\n    ",
    "with lock:\n    ",
)
VULNERABLE_TEMPLATES = {
    "hardcoded_password": (
        "password = 'hunter2'",
        'db_password = "pa55-w0rd"',
        "admin_password='letmein!'",
        "login(user='root', password='toor')",
        "smtp_password = \"mail4ever\"",
    ),
    "eval_usage": (
        "total = eval(expr)",
        "rows = [eval(cell) for cell in cells]",
        "exec(source)",
        "exec(open(path).read())",
        "answer = eval(sys.argv[1], {})",
    ),
    "sql_injection": (
        'cur.execute("select * from t where id = %s" % uid)',
        "db.execute('delete from t where name = \"%s\"' % name)",
        'cur.execute("update t set a = %d where b = %s" % (a, b))',
        "conn.execute('insert into t values (%s)' % value)",
        'cur.execute("select count(*) from %s" % table)',
    ),
    "shell_injection": (
        "os.system('ls ' + folder)",
        "os.system(f'tar xf {archive}')",
        "subprocess.call(command, shell=True)",
        "code = subprocess.call('ping ' + host, shell=True)",
        "os.system(input_line)",
    ),
    "weak_crypto": (
        "h = hashlib.md5(blob).hexdigest()",
        "digest = hashlib.sha1(data).digest()",
        "key = md5(secret)",
        "token = hashlib.sha1(user.encode()).hexdigest()",
        "tag = hmac.new(k, m, hashlib.md5(m).name)",
    ),
    "insecure_random": (
        "token = random.random()",
        "pin = random.randint(1000, 9999)",
        "session = str(random.random())[2:]",
        "salt = [random.randint(0, 255) for _ in range(8)]",
        "otp = '%06d' % random.randint(0, 999999)",
    ),
    "exception_handling": (
        "try:\n    work()\nexcept:\n    pass",
        "try: send(data)\nexcept: pass",
        "try:\n    load(path)\nexcept:\n    result = None",
        "try:\n    a = 1 / b\nexcept ZeroDivisionError:\n    a = 0\nexcept:\n    a = None",
        "try:\n    close()\nexcept:\n    log('failed')\nfinally:\n    done()",
    ),
}
SAFE_TEMPLATES = (
    "total = sum(values)",
    "for item in items: print(item)",
    "digest = hashlib.sha256(blob).hexdigest()",
    "pin = secrets.randbelow(10000)",
    'cur.execute("select * from t where id = ?", (uid,))',
    "subprocess.run(['ls', '-l', folder], check=True)",
    "value = ast.literal_eval(text)",
    "secret = os.environ['APP_SECRET']",
    "try:\n    load(path)\nexcept OSError as error:\n    log(error)",
    "def area(width, height):\n    return width * height",
)
SPLITS = ("train", "validation", "test")


def _pick(values, seed, salt):
    return F.get(
        F.array(*[F.lit(v) for v in values]), (hash_bits(seed, salt, "id") % len(values)).cast("int")
    )


def _confidence(seed, bounds):
    low, high = bounds
    return F.lit(low) + F.lit(high - low) * hash_unit(seed, "confidence", "id")


def template_line(code, template):
    """The first line holding the stripped template, else one."""
    wanted = py_strip(template)
    at = F.array_position(F.transform(split_lines(code), lambda x: F.contains(x, wanted)), True)
    return F.when(at > 0, at).otherwise(1).cast("int")


def vulnerable_samples(
    ids: DataFrame, seed=42, templates=VULNERABLE_TEMPLATES, contexts=CONTEXTS, indent_all=True
) -> DataFrame:
    """One sample per ``id``: a uniform type, then a uniform template of it."""
    picked = ids.select("id").withColumn("vulnerability_type", _pick(templates, seed, "type"))
    template = F.lit(None).cast("string")
    for kind, texts in templates.items():
        template = F.when(F.col("vulnerability_type") == kind, _pick(texts, seed, "template")).otherwise(template)
    picked = picked.withColumns({"template": template, "context": _pick(contexts, seed, "context")})
    return picked.withColumn(
        "code", combine(F.col("context"), F.col("template"), indent_all)
    ).select(
        "id",
        "code",
        "vulnerability_type",
        literal_map(SEVERITY_BY_TYPE, F.col("vulnerability_type"), DEFAULT_SEVERITY).alias("severity"),
        template_line(F.col("code"), F.col("template")).alias("line_number"),
        literal_map(DESCRIPTION_BY_TYPE, F.col("vulnerability_type"), DEFAULT_DESCRIPTION).alias("description"),
        _confidence(seed, VULNERABLE_CONFIDENCE).alias("confidence"),
        F.concat(F.upper("vulnerability_type"), F.lit("_RULE")).alias("rule_id"),
    )


def safe_samples(
    ids: DataFrame, seed=42, templates=SAFE_TEMPLATES, contexts=CONTEXTS, indent_all=True
) -> DataFrame:
    return ids.select("id").select(
        "id",
        combine(_pick(contexts, seed, "context"), _pick(templates, seed, "template"), indent_all).alias("code"),
        F.lit("safe").alias("vulnerability_type"),
        F.lit("info").alias("severity"),
        F.lit(1).alias("line_number"),
        F.lit("No vulnerabilities detected").alias("description"),
        _confidence(seed, SAFE_CONFIDENCE).alias("confidence"),
        F.lit("SAFE_CODE").alias("rule_id"),
    )


def split_samples(samples: DataFrame, ratios=(0.7, 0.15, 0.15), seed=42) -> DataFrame:
    """Add ``split`` with exact sizes: the first shares of all rows in hash order."""
    ranked = shuffled_rank(samples, [], seed, "id")
    size = F.col("group_size")
    train = F.floor(size * F.lit(float(ratios[0])))
    validation = train + F.floor(size * F.lit(float(ratios[1])))
    split = (
        F.when(F.col("rank") <= train, SPLITS[0])
        .when(F.col("rank") <= validation, SPLITS[1])
        .otherwise(SPLITS[2])
    )
    return ranked.withColumn("split", split).drop("rank", "group_size")


def dataset(
    vulnerable_ids: DataFrame, safe_ids: DataFrame, ratios=(0.7, 0.15, 0.15), seed=42, indent_all=True
) -> DataFrame:
    """Vulnerable and safe samples together, split; ids must not overlap.

    All lines of a statement are indented by default, so that every sample parses.
    """
    both = vulnerable_samples(vulnerable_ids, seed, indent_all=indent_all).unionByName(
        safe_samples(safe_ids, seed, indent_all=indent_all)
    )
    return split_samples(both, ratios, seed)


def generate(spark, num_vulnerable: int = 200, num_safe: int = 300, ratios=(0.7, 0.15, 0.15), seed=42) -> DataFrame:
    return dataset(
        spark.range(num_vulnerable), spark.range(num_vulnerable, num_vulnerable + num_safe), ratios, seed
    )
