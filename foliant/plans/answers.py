"""Answers of a model held against a table of rules, path by path.

An answer is read as a VARIANT and walked level by level along the paths that rules name, so each violation says
where it is. The rules are a table: a path may end in a key (``a.b``) or stand for all elements of a list (``a[*]``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "target string, path string, type string, required boolean, max_items int, allowed array<string>"
ASSET_CLASSES = ["auto_loan", "auto_lease", "equipment", "credit_card", "device_payment", "student_loan", "rmbs", "cmbs", "clo", "other"]
FREQUENCIES = ["monthly", "quarterly", "semi_annual", "annual"]
TEST_TYPES = ["overcollateralization", "interest_coverage"]


def _texts(target: str, at: str, needed: str, free: str = "") -> list[tuple]:
    """Rules of text fields under a path, the needed ones and those that may be absent or null."""
    return [(target, at + name, "STRING", is_needed, None, None) for names, is_needed in ((needed, True), (free, False)) for name in names.split()]


#: What an answer to each question may hold.
SCHEMA = [
    *_texts("facts", "", "", "deal_name closing_date payment_frequency_text cleanup_call asset_class_evidence"),
    ("facts", "payment_frequency", "STRING", False, None, FREQUENCIES),
    ("facts", "asset_class", "STRING", True, None, ASSET_CLASSES),
    ("tranches", "items", "ARRAY", True, 30, None),
    ("tranches", "items[*]", "OBJECT", True, None, None),
    *_texts("tranches", "items[*].", "class_name original_balance interest_rate", "rating weighted_average_life"),
    *_texts("tranches", "", "", "stated_total"),
    ("triggers", "items", "ARRAY", True, 20, None),
    ("triggers", "items[*]", "OBJECT", True, None, None),
    *_texts("triggers", "items[*].", "trigger_type metric consequence", "threshold"),
    ("coverage", "items", "ARRAY", True, 30, None),
    ("coverage", "items[*]", "OBJECT", True, None, None),
    *_texts("coverage", "items[*].", "tranche threshold"),
    ("coverage", "items[*].test_type", "STRING", True, None, TEST_TYPES),
]


def schema_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMA, RULES)


def _parent(path: str) -> str:
    return path.removesuffix("[*]") if path.endswith("[*]") else path.rpartition(".")[0]


def violations(answers: DataFrame, rules: list[tuple] = SCHEMA, *, keys: tuple[str, ...] = ("doc_id", "target", "seq")) -> DataFrame:
    """(keys, place, rule, got) of everything in answers (keys, one of them target, and answer) that breaks a rule; valid answers give no row.

    rule: empty (null or blank), json (cannot be read), type, required, max_items or enum. place: the path in the
    answer, from ``$``, with list positions; got: the offending value's beginning, a list's length, or null. A null counts as absent
    where a field may be, and as a wrong type where it is required. Keys that no rule names may stand. Targets
    without rules need to be JSON objects. Keys need not be unique.

    Answers are read and walked in one pass: each level looks up what rules name below its values, and what broke a
    rule goes on to the end as it is.
    """
    named = {(t, path) for t, path, *_ in rules}
    between = {(t, p) for t, path, *_ in rules for p in _parents(path)} - named
    nodes = [*rules, *[(t, p, None, False, None, None) for t, p in sorted(between)]]  # a value's node: the place of its rule here
    first = {(t, path): k for k, (t, path, *_) in reversed(list(enumerate(nodes)))}
    below: dict[tuple[str, str], list[int]] = {}
    for k, (t, path, *_) in enumerate(nodes):
        below.setdefault((t, _parent(path)), []).append(k)
    own = [F.col(f"`{k}`") for k in keys]
    none = F.lit(None).cast("string")

    def found(place: Column, node: Column, v: Column, rule: Column, got: Column) -> Column:
        return F.struct(place.alias("_place"), node.cast("int").alias("_node"), v.alias("_v"), rule.alias("_rule"), got.alias("_got"))

    def children(some: list[int]) -> Column:
        """What stands below a value, for each node there."""
        fields, lists = [], []
        for k in some:
            _, path, _, needed, *_ = nodes[k]
            if path.endswith("[*]"):
                lists.append(F.transform("_list", lambda x, i: found(F.concat("_place", F.lit("["), i.cast("string"), F.lit("]")), F.lit(k), x, none, none)))
            else:
                name = path.rpartition(".")[2]
                child = F.try_variant_get("_v", f'$["{name}"]', "variant")
                fields.append(found(F.concat("_place", F.lit(f".{name}")), F.lit(k), child, F.when(child.isNull(), "required") if needed else none, none))
        out = F.when(F.col("_kind") == "OBJECT", F.array(*fields)) if fields else F.when(F.lit(False), F.array(found(none, F.lit(0), F.col("_v"), none, none)))
        return F.when(F.col("_kind") == "ARRAY", F.concat(*lists)).otherwise(out) if lists else out

    blank = ~F.coalesce(F.col("answer").rlike(r"(?U)\S"), F.lit(False))
    parsed = answers.select(*own, "answer", F.when(~blank, F.try_parse_json("answer")).alias("_v"))
    unread = F.when(blank, "empty").when(F.col("_v").isNull(), "json").when(~F.col("answer").rlike(r"^[ \t\r\n]*\{"), "type")
    got = F.substring(F.when(F.col("_v").isNull(), F.col("answer")).otherwise(F.to_json("_v")), 1, 300)
    level = parsed.select(*own, F.lit("$").alias("_place"), F.lit(-1).alias("_node"), "_v", unread.alias("_rule"), F.when(unread.isNotNull(), got).alias("_got"))
    level = level.withColumns({"_list": F.lit(None).cast("array<variant>"), "_kind": F.when(F.col("_rule").isNull(), "OBJECT")})

    of = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("_node"))
    allowed = F.get(F.array(*[(F.array(*map(F.lit, a)) if a else F.lit(None)).cast("array<string>") for *_, a in nodes]), F.col("_node"))
    depths = [len(_parents(path)) for _, path, *_ in nodes]
    for depth in range(max(depths, default=0)):
        kids = F
        for (t, path), some in below.items():
            if depths[some[0]] == depth + 1:
                kids = kids.when(F.col("_node") == first[t, path] if path else (F.col("_node") == -1) & (F.col("target") == t), children(some))
        kept = F.when(F.col("_rule").isNotNull(), F.array(found(F.col("_place"), F.lit(None), F.lit(None).cast("variant"), F.col("_rule"), F.col("_got"))))
        down = level.select(*own, F.explode(F.flatten(F.filter(F.array(kept, kids), lambda x: x.isNotNull()))).alias("_x")).select(*own, "_x.*")
        kind = F.when(F.col("_list").isNotNull(), "ARRAY").when(F.try_variant_get("_v", "$", "map<string,variant>").isNotNull(), "OBJECT").when(F.col("_v").isNotNull(), F.substring_index(F.schema_of_variant("_v"), "(", 1))
        seen = down.withColumn("_list", F.try_variant_get("_v", "$", "array<variant>")).withColumn("_kind", kind)
        is_type = F.col("_type").isNull() | (F.col("_kind") == F.col("_type")) | ((F.col("_kind") == "VOID") & ~of([r[3] for r in nodes], "boolean"))
        text = F.try_variant_get("_v", "$", "string")
        broken = (
            F.when(~is_type, F.struct(F.lit("type").alias("rule"), F.substring(F.to_json("_v"), 1, 300).alias("got")))
            .when(F.size("_list") > of([r[4] for r in nodes], "int"), F.struct(F.lit("max_items").alias("rule"), F.size("_list").cast("string").alias("got")))
            .when((F.col("_kind") == "STRING") & ~F.array_contains(allowed, text), F.struct(F.lit("enum").alias("rule"), F.substring(text, 1, 300).alias("got")))
        )
        judged = seen.withColumn("_type", of([r[2] for r in nodes], "string")).withColumn("_b", F.when(F.col("_v").isNotNull(), broken))
        level = judged.select(*own, "_place", "_node", "_v", F.coalesce("_rule", "_b.rule").alias("_rule"), F.coalesce("_got", "_b.got").alias("_got"), "_list", "_kind")
    # No filter on what was judged: it would be pushed below and judge everything twice.
    broke = F.when(F.col("_rule").isNotNull(), F.array(F.struct(F.col("_place").alias("place"), F.col("_rule").alias("rule"), F.col("_got").alias("got"))))
    return level.select(*own, F.explode(broke).alias("_x")).select(*own, "_x.*")


def _parents(path: str) -> list[str]:
    """A path's own steps from the root, the path last."""
    out = []
    while path:
        out.insert(0, path)
        path = _parent(path)
    return out


def checked(answers: DataFrame, rules: list[tuple] = SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(answers without a violation, one issue an answer with one): answers (doc_id, target, seq, answer, ...), the raw answer kept beside the first violation by place."""
    keys = ["doc_id", "target", "seq"]
    found = violations(answers, rules)
    first = found.groupBy(*keys).agg(F.min(F.struct("place", "rule", "got")).alias("first"), F.count(F.lit(1)).alias("n_violations"))
    bad = answers.join(first, keys).select(*keys, "first.place", "first.rule", "first.got", "n_violations", F.col("answer").alias("raw"))
    return answers.join(first, keys, "left_anti"), bad
