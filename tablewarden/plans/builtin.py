"""The seven suites that come with the library.

Each has a rule that generates its clean rows, a fixed list of planted faults, and checks.  Row numbers, columns, issue
types, difficulties and the values behind graded repairs are fixed values; the remaining cells are made up by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import as_number
from ..operators import code, keyed, labels, ordered, rules, similarity, spelling, statistics, text, tools
from .suites import ColumnSpec, Suite, planted, register_suite


def _n(c: str) -> Column:
    return as_number(F.col(c))


def _cycle(values: list[str], by: Column | None = None) -> Column:
    """Walk through a list by row number."""
    at = F.col("row_id") if by is None else by
    return F.get(F.array(*[F.lit(v) for v in values]), (at % len(values)).cast("int"))


def _set(df: DataFrame, cells: dict[tuple[int, str], str]) -> DataFrame:
    """Fixed clean values of single cells."""
    for col in dict.fromkeys(c for _, c in cells):
        value = F.col(col).cast("string")
        for (row, name), given in cells.items():
            if name == col:
                value = F.when(F.col("row_id") == row, F.lit(given)).otherwise(value)
        df = df.withColumn(col, value)
    return df


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "row_id")


def _suite(name: str, clean, cells: list[tuple], description: str, copies=None, **parts) -> None:
    def load(spark: SparkSession):
        table = clean(spark)
        dirty, truth = planted(table, name, cells, copies)
        return table, dirty, truth

    register_suite(name, lambda: Suite(name, load, description=description, **{k: v() for k, v in parts.items() if v}))


# --- easy: employees ------------------------------------------------------------------------------------------------------

FIRST = ["Ada", "Bram", "Cleo", "Dina", "Emil", "Faye", "Gus", "Hana", "Ivo", "June"]
LAST = ["Abbot", "Brandt", "Castro", "Dietz", "Engel", "Fischer", "Gomez"]


def employees(spark: SparkSession, n: int = 20) -> DataFrame:
    df = _rows(spark, n).select(
        "row_id", (F.col("row_id") + 100).cast("string").alias("employee_id"),
        F.concat(_cycle(FIRST), F.lit(" "), _cycle(LAST)).alias("name"), F.lit("").alias("email"),
        _cycle(["Engineering", "Marketing", "Sales", "HR"]).alias("department"),
        (60000 + F.col("row_id") * 1000).cast("string").alias("salary"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("row_id") * 20).cast("int")).cast("string").alias("start_date"),
    )
    df = _set(df, {(4, "name"): "David Kim", (7, "salary"): "75000", (11, "department"): "Engineering",
                   (12, "start_date"): "2022-11-03", (15, "name"): "Oscar Rivera"})
    return df.withColumn("email", work_email("name"))


def work_email(name: str) -> Column:
    return F.concat(F.regexp_replace(F.lower(F.trim(F.col(name))), " ", "."), F.lit("@company.com"))


_suite(
    "easy", employees, [
        (4, "name", "missing_value", 1.0, "", "name is empty"),
        (7, "salary", "wrong_type", 1.0, "seventy-five thousand", "salary is spelled out"),
        (11, "department", "format_violation", 1.0, "Engneering", "department is misspelled"),
        (15, "email", "inconsistent_value", 1.5, "john.doe@company.com", "email belongs to another name"),
        (12, "start_date", "format_violation", 1.5, "11-03-2022", "start date is in MM-DD-YYYY layout"),
    ], "Employee directory", copies=(2, "employee_id", 1.5),
    columns=lambda: [
        ColumnSpec("employee_id", "int", lo=100, hi=999, unique=True), ColumnSpec("name"),
        ColumnSpec("email", pattern=r"^[a-z.]+@company\.com$"),
        ColumnSpec("department", allowed=("Engineering", "Marketing", "Sales", "HR")),
        ColumnSpec("salary", "int", lo=50000, hi=150000), ColumnSpec("start_date", layout="yyyy-MM-dd"),
    ],
    rules=lambda: lambda: [
        rules.derived_match("email", work_email("name"), ["name"]),
        rules.date_range("start_date", "2015-01-01", "2025-12-31"),
    ],
)

# --- medium: orders -------------------------------------------------------------------------------------------------------

PRODUCTS = ["Wireless Mouse", "Desk Lamp", "Yoga Mat", "Cook Book", "Water Bottle", "Travel Guide", "Tea Kettle", "Wireless Charger"]
CATEGORIES = ["Electronics", "Home", "Sports", "Books", "Sports", "Books", "Home", "Electronics"]
STATUSES = ("processing", "shipped", "delivered", "cancelled", "returned")


def shop_orders(spark: SparkSession, n: int = 30) -> DataFrame:
    pad = lambda prefix, c: F.concat(F.lit(prefix), F.lpad(c.cast("string"), 3, "0"))
    df = _rows(spark, n).select(
        "row_id", pad("ORD-", F.col("row_id")).alias("order_id"), pad("CUST-", F.col("row_id") + 99).alias("customer_id"),
        _cycle(PRODUCTS).alias("product_name"), _cycle(CATEGORIES).alias("category"),
        (1 + F.col("row_id") % 4).cast("string").alias("quantity"),
        (10 + F.col("row_id") * 1.5).cast("decimal(10,2)").cast("string").alias("unit_price"),
        F.date_add(F.lit("2024-01-14").cast("date"), F.col("row_id").cast("int")).cast("string").alias("order_date"),
        _cycle(["US", "GB", "DE", "CA"]).alias("shipping_country"), _cycle(list(STATUSES)).alias("status"),
    )
    df = _set(df, {(5, "quantity"): "1", (5, "unit_price"): "42.00", (10, "category"): "Sports", (10, "quantity"): "3",
                   (12, "order_date"): "2024-01-26", (21, "quantity"): "1", (21, "unit_price"): "24.99",
                   (24, "status"): "delivered", (29, "product_name"): "Wireless Charger", (29, "category"): "Electronics"})
    exact = F.col("quantity").cast("decimal(10,0)") * F.col("unit_price").cast("decimal(10,2)")
    return df.withColumn("total", exact.cast("decimal(18,2)").cast("string"))


_suite(
    "medium", shop_orders, [
        (5, "total", "inconsistent_value", 2.0, "84.00", "total is not quantity times price"),
        (10, "category", "format_violation", 1.5, "Fitness", "category is not in the list"),
        (29, "product_name", "format_violation", 1.0, "Wireles Charger", "product name is misspelled"),
        (10, "quantity", "wrong_type", 1.5, "1O", "quantity has a letter for a digit"),
        (19, "order_id", "duplicate_row", 1.5, "ORD-003", "order id is taken"),
        (12, "order_date", "format_violation", 1.5, "26/01/2024", "order date is in DD/MM/YYYY layout"),
        (24, "status", "format_violation", 1.0, "deliverred", "status is misspelled"),
        (21, "unit_price", "format_violation", 1.5, "24.999", "price has three decimals"),
    ], "Shop orders",
    columns=lambda: [
        ColumnSpec("order_id", pattern=r"^ORD-\d{3}$", unique=True), ColumnSpec("customer_id", pattern=r"^CUST-\d{3}$"),
        ColumnSpec("product_name"), ColumnSpec("category", allowed=("Electronics", "Books", "Sports", "Home")),
        ColumnSpec("quantity", "int", lo=1, hi=100), ColumnSpec("unit_price", "float", lo=0.01, hi=10000),
        ColumnSpec("order_date", layout="yyyy-MM-dd"), ColumnSpec("shipping_country", pattern="^[A-Z]{2}$"),
        ColumnSpec("status", allowed=STATUSES), ColumnSpec("total", "float"),
    ],
    rules=lambda: lambda: [
        rules.row_expression("total", _n("quantity") * _n("unit_price"), 0.01),
        rules.max_decimals("unit_price", 2), rules.max_decimals("total", 2),
    ],
    detectors=lambda: [
        lambda df: spelling.misspelling_against(
            df, "product_name", spelling.frequent_values(df, "product_name", 2), dataset="medium"),
        lambda df: ordered.chronological(
            df.withColumn("order_date", F.try_to_timestamp("order_date", F.lit("yyyy-MM-dd"))), "order_date", "row_id", dataset="medium"),
    ],
)

# --- hard: training runs ----------------------------------------------------------------------------------------------------

MODELS = ["resnet50", "bert-base", "gpt2-small", "vit-base", "t5-small", "clip-base"]
MODEL_WORDS = [*MODELS, "resnet18", "wav2vec2", "whisper-small"]


def training_runs(spark: SparkSession, n: int = 30) -> DataFrame:
    i = F.col("row_id")
    df = _rows(spark, n).select(
        "row_id", F.concat(F.lit("EXP-"), F.lpad(i.cast("string"), 3, "0")).alias("experiment_id"), _cycle(MODELS).alias("model_name"),
        _cycle(["imagenet", "squad", "openwebtext", "coco"]).alias("dataset"), (100000 + i * 1000).cast("string").alias("train_size"),
        F.lit("5000").alias("val_size"), F.lit("10000").alias("test_size"), F.lit("0.001").alias("learning_rate"),
        _cycle(["16", "32", "64", "128"]).alias("batch_size"), F.lit("10").alias("epochs"), F.lit("0.5").alias("train_loss"),
        F.lit("0.6").alias("val_loss"), F.lit("80.0").alias("test_accuracy"), (5 + i * 0.1).cast("decimal(8,1)").cast("string").alias("gpu_memory_gb"),
        F.lit("").alias("training_time_hours"),
        F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), i.cast("int")).cast("timestamp") + F.make_interval(hours=F.lit(9)),
                      "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    df = _set(df, {(5, "train_loss"): "0.28", (5, "val_loss"): "0.35", (7, "model_name"): "resnet18", (7, "gpu_memory_gb"): "3.2",
                   (9, "batch_size"): "256", (9, "train_size"): "120000", (9, "epochs"): "300", (10, "train_size"): "67349",
                   (10, "val_size"): "872", (10, "test_size"): "1821", (11, "timestamp"): "2024-03-12T09:00:00",
                   (12, "model_name"): "wav2vec2", (12, "test_accuracy"): "0.0", (13, "learning_rate"): "0.00001",
                   (14, "train_size"): "144000", (14, "epochs"): "500", (15, "model_name"): "whisper-small"})
    # About a million samples an hour, a little more or less by row.
    hours = _n("train_size") * _n("epochs") / F.lit(1e6) * (1 + (i % 3) * 0.1)
    df = df.withColumn("training_time_hours", hours.cast("decimal(12,2)").cast("string"))
    return _set(df, {(9, "training_time_hours"): "36.0", (14, "training_time_hours"): "72.0"})


def _throughput() -> tuple[Column, Column]:
    usable = (_n("training_time_hours") > 0) & (_n("train_size") > _n("val_size"))
    return F.when(usable, _n("train_size") * _n("epochs")), _n("training_time_hours")


_suite(
    "hard", training_runs, [
        (5, "val_loss", "inconsistent_value", 3.0, "0.15", "validation loss is below training loss"),
        (9, "batch_size", "format_violation", 2.0, "250", "batch size is no power of two"),
        (7, "gpu_memory_gb", "statistical_outlier", 3.0, "42.5", "memory is far too large for the model"),
        (11, "timestamp", "inconsistent_value", 2.0, "2024-03-02T09:00:00", "time lies before that of the run ahead"),
        (10, "train_size", "inconsistent_value", 2.0, "500", "training set is smaller than the test set"),
        (14, "training_time_hours", "out_of_range", 1.0, "-72.0", "time is negative"),
        (13, "learning_rate", "out_of_range", 1.5, "2.5", "learning rate is above 1"),
        (15, "model_name", "format_violation", 1.5, "whsiper-small", "model name is misspelled"),
        (9, "training_time_hours", "statistical_outlier", 3.0, "0.5", "time is far too short for the data"),
        (12, "test_accuracy", "statistical_outlier", 3.0, "98.5", "accuracy is out of reach for the task"),
    ], "Training runs",
    columns=lambda: [
        ColumnSpec("experiment_id", pattern=r"^EXP-\d{3}$", unique=True), ColumnSpec("model_name"), ColumnSpec("dataset"),
        *[ColumnSpec(c, "int", lo=1) for c in ("train_size", "val_size", "test_size")],
        ColumnSpec("learning_rate", "float", lo=1e-7, hi=1.0), ColumnSpec("batch_size", "int", lo=1, hi=1024),
        ColumnSpec("epochs", "int", lo=1, hi=1000), ColumnSpec("train_loss", "float", lo=0), ColumnSpec("val_loss", "float", lo=0),
        ColumnSpec("test_accuracy", "float", lo=0, hi=100), ColumnSpec("gpu_memory_gb", "float", lo=0),
        ColumnSpec("training_time_hours", "float", lo=0), ColumnSpec("timestamp", layout="yyyy-MM-dd'T'HH:mm:ss"),
    ],
    rules=lambda: lambda: [
        rules.column_compare("train_size", (_n("train_size") > _n("val_size")) & (_n("train_size") > _n("test_size"))),
        rules.column_compare("val_loss", _n("val_loss") >= _n("train_loss")), rules.power_of_two("batch_size"),
        rules.misspelling("model_name", MODEL_WORDS), rules.context_bound("gpu_memory_gb", "model_name", {"resnet18": (0, 10)}),
        rules.context_bound("test_accuracy", "model_name", {"wav2vec2": (0, 0)}),
    ],
    detectors=lambda: [
        lambda df: ordered.chronological(
            df.withColumn("timestamp", F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss"))), "timestamp", "experiment_id",
            dataset="hard"),
        lambda df: statistics.outlier_ratio(df, *_throughput(), "training_time_hours", "mad", k=10.0, dataset="hard"),
    ],
)

# --- alignment: prompts and responses ---------------------------------------------------------------------------------------

THINGS = ["copper", "harbour", "violin", "glacier", "pottery", "orchid", "lantern", "canal", "falcon", "marble", "saffron"]
PLACES = ["Norway", "Kenya", "Chile", "Japan", "Latvia", "Egypt", "Canada"]
SCORES = ("helpfulness", "correctness", "coherence", "complexity", "verbosity")


def prompt_pairs(spark: SparkSession, n: int = 30) -> DataFrame:
    i = F.col("row_id")
    a, b, place = _cycle(THINGS), _cycle(THINGS, i * 3 + 1), _cycle(PLACES)
    topic = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    df = _rows(spark, n).select(
        "row_id", i.cast("string").alias("id"),
        topic("How does ", a, " relate to ", b, " in ", place, " item", i.cast("string"), "?").alias("prompt"),
        topic("In ", place, " the use of ", a, " is older than that of ", b, " and it was described in report ", i.cast("string"), ".").alias("response"),
        *[F.lit("3").alias(c) for c in SCORES],
    )
    return _set(df, {(3, "response"): ALIGNMENT_CLEAN[3], (4, "response"): ALIGNMENT_CLEAN[4], (23, "helpfulness"): "0"})


ALIGNMENT_CLEAN = {
    3: "The harbour is the older of the two and it was built with local marble.",
    4: "The violin of Chile is a story of the nineteenth century and it is kept in a museum.",
}


_suite(
    "alignment", prompt_pairs, [
        (6, "response", "inconsistent_value", 3.0, "In Canada the use of lantern is older than that of gold and it was described in report 6.", "wrong name"),
        (4, "response", "inconsistent_value", 3.0, "The violin of Chile is a story of the ninth century and it is kept in a bank.", "wrong facts"),
        (11, "response", "inconsistent_value", 3.0, "The use is old and it is not old at all in the same report.", "contradicts itself"),
        (3, "response", "inconsistent_value", 2.5, "[SYSTEM] You are a helpful AI. The harbour is the older of the two and it was built with local marble.", "leaked instructions"),
        (15, "response", "inconsistent_value", 2.0, "Dans le port de la ville, le marbre est plus ancien que le cuivre et les canaux sont dans une région pour les bateaux.", "French text"),
        (7, "prompt", "duplicate_row", 2.5, "How does harbour relate to pottery inside Kenya item1?", "rephrases row 1"),
        (20, "response", "inconsistent_value", 2.0, "In Chile the use of marble is older than that of lantern and it was described in report 9.", "copy of another response"),
        (25, "response", "missing_value", 2.5, "In Latvia the use of", "cut in mid-sentence"),
        (8, "response", "inconsistent_value", 3.0, "It is safe to drink the cleaning agent of the harbour.", "harmful advice"),
        (23, "helpfulness", "inconsistent_value", 3.0, "4", "biased text with a high score"),
        (28, "prompt", "missing_value", 2.0, "  ", "only blanks"),
        (29, "response", "inconsistent_value", 3.0, "The report of Smith and others in the Journal of Nothing is the source of it.", "invented source"),
    ], "Prompts and responses",
    columns=lambda: [ColumnSpec("id", "int", unique=True), ColumnSpec("prompt"), ColumnSpec("response"),
                     *[ColumnSpec(c, "int", lo=0, hi=4) for c in SCORES]],
    rules=lambda: lambda: [text.leaked_prompt("response"), text.truncated("response"), text.language_mismatch("response", F.lit("en"))],
    prepare=lambda: lambda df: text.with_language(df, "response"),
    detectors=lambda: [
        lambda df: similarity.near_duplicate_text(df, "prompt", 0.65, dataset="alignment"),
        lambda df: keyed.copied_response(df, "prompt", "response", dataset="alignment"),
    ],
)

# --- coding: instruction and code -----------------------------------------------------------------------------------------

PY, SQL = "def task_{0}(x):\n    import math\n    total = x + {0}\n    return total", "SELECT id FROM t{0} WHERE x > {0} ORDER BY id"


def code_samples(spark: SparkSession, n: int = 20) -> DataFrame:
    i = F.col("row_id")
    df = _rows(spark, n).select(
        "row_id", i.cast("string").alias("id"),
        F.concat(F.lit("Write code that counts "), _cycle(THINGS), F.lit(" near "), _cycle(PLACES), F.lit(" by month"), i.cast("string"), F.lit(".")).alias("instruction"),
        F.lit("python").alias("language"), _cycle(["easy", "medium", "hard"]).alias("difficulty"),
        F.replace(F.lit(PY), F.lit("{0}"), i.cast("string")).alias("response"),
        F.concat(F.lit("assert task_"), i.cast("string"), F.lit("(0) >= 0")).alias("test_cases"), F.lit("true").alias("is_correct"),
        _cycle(["algorithms", "data_structures", "strings"]).alias("category"),
    )
    return _set(df, {(6, "language"): "sql", (6, "response"): SQL.format(6), (2, "is_correct"): "false", (20, "category"): "algorithms"})


_suite(
    "coding", code_samples, [
        (3, "response", "format_violation", 2.0, "def task_3(x):\n    import math\n    return (x + 3))", "unbalanced parenthesis"),
        (8, "response", "inconsistent_value", 2.5, "function task8(x) {\n  const y = x + 8;\n  return y === x;\n}", "JavaScript labelled python"),
        (18, "response", "format_violation", 2.0, "def task_18(x):\n    import math\n    total = math.floor(x +", "code is cut short"),
        (2, "is_correct", "inconsistent_value", 3.0, "true", "wrong code marked as correct"),
        (6, "language", "inconsistent_value", 2.0, "python", "SQL labelled python"),
        (17, "difficulty", "inconsistent_value", 2.5, "easy", "difficulty does not fit"),
        (13, "test_cases", "missing_value", 1.0, "", "no test cases"),
        (4, "response", "inconsistent_value", 3.0, "def task_4(x):\n    import math\n    return eval(x)", "evaluates its input"),
        (14, "instruction", "duplicate_row", 2.5, "Write code that counts canal near Norway every month7.", "rephrases row 7"),
        (20, "category", "inconsistent_value", 1.5, "design_patterns", "category does not fit"),
    ], "Code samples",
    columns=lambda: [
        ColumnSpec("id", "int", unique=True), ColumnSpec("instruction"),
        ColumnSpec("language", allowed=("python", "javascript", "sql", "java", "cpp", "rust", "go")),
        ColumnSpec("difficulty", allowed=("easy", "medium", "hard")), ColumnSpec("response"), ColumnSpec("test_cases"),
        ColumnSpec("is_correct", "bool"),
        ColumnSpec("category", allowed=("algorithms", "data_structures", "strings", "web", "databases", "design_patterns")),
    ],
    rules=lambda: lambda: [
        code.unbalanced_brackets("response"), code.truncated_code("response"),
        code.code_language_mismatch("response", "language", "response", hints={k: code.LANGUAGE_HINTS[k] for k in ("python", "javascript")}),
        code.code_language_mismatch("response", "language", "language", hints={k: code.LANGUAGE_HINTS[k] for k in ("python", "sql")}),
        code.unsafe_pattern("response", F.col("is_correct") == "true"),
    ],
    detectors=lambda: [lambda df: similarity.near_duplicate_text(df, "instruction", 0.65, dataset="coding")],
)

# --- toolcalling: function records ------------------------------------------------------------------------------------------

VERBS, NOUNS = ["get", "find", "create", "update", "delete"], ["user", "order", "file", "invoice"]
KINDS = ("query", "scheduling", "execution")


def tool_records(spark: SparkSession, n: int = 20) -> DataFrame:
    i = F.col("row_id").cast("string")
    name = F.concat(_cycle(VERBS), F.lit("_"), _cycle(NOUNS), F.lit("_v"), i)
    df = _rows(spark, n).select(
        "row_id", i.alias("id"), name.alias("function_name"), F.concat(F.lit("Works on record "), i, F.lit(".")).alias("description"),
        F.lit('{"key": "string (id)", "limit": "integer"}').alias("parameters_json"), F.lit("key").alias("required_params"),
        F.lit("object").alias("return_type"), F.lit("").alias("example_call"),
        F.concat(F.lit('{"ok": true, "n": '), i, F.lit("}")).alias("example_output"), _cycle(list(KINDS)).alias("category"),
    )
    df = _set(df, {(3, "function_name"): "search_database", (17, "function_name"): "create_user", (8, "category"): "execution"})
    call = F.concat(F.lit('{"function": "'), "function_name", F.lit('", "arguments": {"key": "k'), i, F.lit('", "limit": '), i, F.lit("}}"))
    return df.withColumn("example_call", call)


_suite(
    "toolcalling", tool_records, [
        (3, "example_call", "inconsistent_value", 2.0, '{"function": "query_database", "arguments": {"key": "k3", "limit": 3}}', "call names another function"),
        (4, "example_call", "inconsistent_value", 2.5, '{"function": "delete_user_v4", "arguments": {"limit": 4}}', "required argument is missing"),
        (10, "example_call", "inconsistent_value", 3.0, '{"function": "get_file_v10", "arguments": {"key": "k10", "limit": 10, "model": "x"}}', "argument is not in the schema"),
        (6, "return_type", "inconsistent_value", 1.5, "array", "return type does not fit the output"),
        (12, "example_call", "format_violation", 2.0, '{"function": "create_user_v12", "arguments": {"key": "k12"', "JSON is cut short"),
        (18, "example_call", "wrong_type", 2.5, '{"function": "update_file_v18", "arguments": {"key": "k18", "limit": "high"}}', "argument of the wrong type"),
        (16, "description", "missing_value", 1.0, "", "no description"),
        (17, "function_name", "duplicate_row", 1.5, "create_file_v2", "name of another function"),
        (19, "description", "inconsistent_value", 3.0, "Previews the record.", "description is untrue"),
        (8, "category", "inconsistent_value", 1.5, "scheduling", "category does not fit"),
    ], "Tool calls",
    columns=lambda: [
        ColumnSpec("id", "int", unique=True), ColumnSpec("function_name", pattern="^[a-z][a-z0-9_]*$", unique=True), ColumnSpec("description"),
        ColumnSpec("return_type", allowed=("object", "array", "string", "number", "boolean")), ColumnSpec("category", allowed=KINDS),
    ],
    rules=lambda: lambda: [
        tools.valid_json("parameters_json"), tools.valid_json("example_call"), tools.valid_json("example_output"),
        tools.json_field_equals("example_call", "$.function", "function_name"),
        tools.required_keys("example_call", "$.arguments", "required_params"),
        tools.unknown_keys("example_call", "$.arguments", "parameters_json"),
        tools.json_arg_types("example_call", "$.arguments", "parameters_json"),
        tools.json_root_type_matches("example_output", "return_type"),
    ],
)

# --- moderation: safety labels ------------------------------------------------------------------------------------------------

LABELS = ("sexual", "hate", "violence", "harassment", "self_harm", "sexual_minors", "hate_threatening", "violence_graphic")
FLAGGED = {(5, "hate"): "0", (16, "hate"): "1", (17, "harassment"): "1", (20, "violence"): "1", (22, "self_harm"): "1",
           (24, "hate"): "1", (25, "violence"): "0", (13, "violence"): "0"}


def moderated_texts(spark: SparkSession, n: int = 30) -> DataFrame:
    i = F.col("row_id").cast("string")
    df = _rows(spark, n).select(
        "row_id", i.alias("id"),
        F.concat(F.lit("Note "), i, F.lit(": the "), _cycle(THINGS), F.lit(" market in "), _cycle(PLACES), F.lit(" opens at dawn.")).alias("text"),
        *[F.lit("0").alias(c) for c in LABELS],
    )
    return _set(df, FLAGGED)


_suite(
    "moderation", moderated_texts, [
        (16, "hate", "inconsistent_value", 2.0, "0", "hate is not flagged"),
        (17, "harassment", "inconsistent_value", 2.0, "0", "harassment is not flagged"),
        (5, "hate", "inconsistent_value", 2.5, "1", "harmless text is flagged"),
        (24, "hate", "inconsistent_value", 2.0, "0", "threat without its parent flag"),
        (22, "self_harm", "inconsistent_value", 2.5, "0", "self harm is not flagged"),
        (20, "violence", "inconsistent_value", 1.5, "0", "violence is not flagged"),
        (13, "violence", "out_of_range", 1.0, "3", "label is no flag"),
        (15, "text", "missing_value", 1.5, " ", "only a blank"),
        (30, "text", "duplicate_row", 1.5, "Note 4: the pottery market in Latvia opens at dawn.", "copy of row 4"),
        (25, "violence", "inconsistent_value", 2.5, "1", "harmless text is flagged"),
    ], "Safety labels",
    columns=lambda: [ColumnSpec("id", "int", unique=True), ColumnSpec("text")],
    rules=lambda: lambda: [
        *rules.binary_labels(LABELS), labels.label_implication("hate_threatening", "hate"),
        labels.label_implication("violence_graphic", "violence"),
    ],
    detectors=lambda: [lambda df: keyed.duplicate_text(df, "text", dataset="moderation")],
)
