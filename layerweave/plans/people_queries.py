"""Queries: raw answers, repairs, codes, names and goals."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerweave.functions import cleaning as C
from layerweave.functions.places import find_countries
from layerweave.operators import people as P
from layerweave.operators import scores as S
from layerweave.plans.inputs import USER_SCORES, user_scores
from layerweave.plans.registry import query, table
from layerweave.session import scratch_path
from layerweave.sources import fixed_width as W
from layerweave.sources.delimited import array_to_text, read_lines_without_header, text_to_array, write_csv

# --- raw answer lines out of the customers ----------------------------------------------------

_PARTS = {
    "ss": "(c_custkey * 7) % 62",
    "mm": "(c_custkey * 11) % 63",
    "hh": "(c_custkey * 13) % 26",
    "dd": "(c_custkey * 17) % 32",
    "mo": "(c_custkey * 5) % 14",
    "yy": "80 + c_custkey % 40",
}
_WIDTH = {"ss": 2, "mm": 2, "hh": 2, "dd": 2, "mo": 2, "yy": 3}
_ITEMS_TEXT = "substr(concat(md5(c_name), md5(concat(c_mktsegment, c_name)), md5(concat(c_name, 'x')), md5(concat(c_name, 'y'))), 1, 120)"
_LINE = (
    "concat(lpad(cast(c_custkey + 1 as string), {width}, '0'), cast(c_custkey % 3 + 1 as string), lpad(cast(18 + c_nationkey as string), 2, '0'), "
    + ", ".join(f"lpad(cast({e} as string), {_WIDTH[p]}, '0')" for p, e in _PARTS.items())
    + f", rpad(substr(lower(n_name), 1, 9), 9, ' '), {_ITEMS_TEXT})"
)


# Answer lines that one task makes and parses.
LINES_PER_TASK = 20_000


def key_width(spark, folder) -> int:
    """Digits of the largest case number, six at least."""
    largest = table(spark, folder, "customer").agg(F.max("c_custkey").alias("k")).first()["k"]
    return max(6, len(str((largest or 0) + 1)))


def answer_layout(spark, folder):
    return W.questionnaire_layout(key_width=key_width(spark, folder))


def answer_lines(spark, folder):
    # A small file of many customers is read by one task; the lines are made and parsed by more.
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    customers = customers.repartition(-(-customers.count() // LINES_PER_TASK) or 1)
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return customers.join(nations, "c_nationkey").select(F.expr(_LINE.format(width=key_width(spark, folder))).alias("value"))


def _repair_sql(strict: bool) -> str:
    hour = "NULL" if strict else "CASE WHEN mm <= 59 AND ss <= 59 THEN make_timestamp(y, mo, dd, hh % 24, mm, ss::DOUBLE) END"
    return f"""CASE
    WHEN mo NOT BETWEEN 1 AND 12 THEN CASE WHEN hh <= 23 AND mm <= 59 AND ss <= 59 THEN make_timestamp(y, 1, 1, hh, mm, ss::DOUBLE) END
    WHEN dd < 1 OR dd > day(last_day(make_date(y, mo, 1))) THEN CASE WHEN mo < 12 AND hh <= 23 AND mm <= 59 AND ss <= 59 THEN make_timestamp(y, mo + 1, 1, hh, mm, ss::DOUBLE) END
    WHEN hh > 23 THEN {hour}
    WHEN mm > 59 THEN CASE WHEN ss <= 59 THEN make_timestamp(y, mo, dd, hh, mm % 59, ss::DOUBLE) END
    WHEN ss > 59 THEN TIMESTAMP '1900-01-01 00:00:00'
    ELSE make_timestamp(y, mo, dd, hh, mm, ss::DOUBLE) END"""


_RAW = "raw AS (SELECT customer.*, n_name, 1900 + yy AS y, q.* EXCLUDE (k) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT c_custkey AS k, " + ", ".join(
    f"{e} AS {p}" for p, e in _PARTS.items()
) + " FROM customer) q ON k = c_custkey)"


def _parsed_sql(strict: bool = False) -> str:
    return (
        f"{_RAW}, parsed AS (SELECT (c_custkey + 1)::INT AS \"case\", CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'None' END AS sex, "
        f"(18 + c_nationkey)::INT AS age, {_repair_sql(strict)} AS date, substr(lower(n_name), 1, 9) AS country, "
        f"[TRY_CAST(c AS FLOAT) FOR c IN string_split({_ITEMS_TEXT}, '')] AS items FROM raw)"
    )


_PEOPLE_COLUMNS = ["case", "sex", "age", "date", "country"]


@query(
    "fixed_width",
    f"WITH {_parsed_sql()} SELECT \"case\", sex, age, date, country, len(list_filter(items, lambda x: x IS NOT NULL))::INT AS answered, "
    "list_sum(list_transform(items, lambda x: coalesce(x, 0)::DOUBLE)) AS total FROM parsed",
)
def fixed_width(spark, folder):
    """Lines written as text, read back and parsed by the layout of 125 fields."""
    path = scratch_path(spark, "answers")
    answer_lines(spark, folder).write.text(path)
    people = W.read_fixed_width(spark, path, answer_layout(spark, folder))
    items = [F.col(f"i{n}") for n in range(1, 121)]
    values = F.array(*items)
    return people.select(
        *_PEOPLE_COLUMNS,
        F.size(F.filter(values, lambda x: x.isNotNull())).alias("answered"),
        F.aggregate(values, F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)).cast("double")).alias("total"),
    )


@query("repair_dates", f"WITH {_parsed_sql()} SELECT \"case\", date FROM parsed")
def repair_dates(spark, folder):
    """Timestamps with every kind of bad part, repaired once."""
    layout = answer_layout(spark, folder)
    return W.parse_lines(answer_lines(spark, folder), [layout[0], layout[3]])


@query("repair_dates_strict", f"WITH {_parsed_sql(True)} SELECT \"case\", date FROM parsed")
def repair_dates_strict(spark, folder):
    """The same with an hour out of range left unknown."""
    layout = answer_layout(spark, folder)
    return W.parse_lines(answer_lines(spark, folder), [layout[0], layout[3]], strict=True)


@query(
    "code_map",
    "SELECT doc_id, CASE quality * 2 + toxic WHEN 0 THEN 'poor' WHEN 2 THEN 'good' ELSE 'None' END AS verdict FROM labels",
)
def code_map(spark, folder):
    """Number codes to words with a default."""
    labels = table(spark, folder, "labels")
    code = (F.col("quality") * 2 + F.col("toxic")).cast("string")
    return labels.select("doc_id", C.code_map(code, {"0": "poor", "2": "good"}, "None").alias("verdict"))


_COUNTRY_TEXT = "CASE c_custkey % 5 WHEN 0 THEN ' ' || n_name || ' ' WHEN 1 THEN lower(substr(n_name, 1, 8)) WHEN 2 THEN substr(n_name, 4) WHEN 3 THEN 'South Kor' ELSE 'Atlantis' END"


@query(
    "country_code",
    "WITH listed AS (SELECT lower(n_name) AS name, upper(substr(md5(n_name), 1, 3)) AS code FROM nation), "
    f"texts AS (SELECT c_custkey, {_COUNTRY_TEXT} AS country FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "found AS (SELECT c_custkey, any_value(country) AS country, arg_min(code, (name <> lower(trim(country)), instr(name, lower(trim(country))), code)) "
    "FILTER (WHERE instr(name, lower(trim(country))) > 0) AS code FROM texts, listed GROUP BY c_custkey) "
    "SELECT c_custkey, country, coalesce(code, CASE lower(trim(country)) WHEN 'south kor' THEN 'KOR' WHEN 'st lucia' THEN 'LCA' ELSE 'ZZZ' END) AS country_code FROM found",
)
def country_code(spark, folder):
    """Whole names, parts of names, overrides and unknown texts."""
    nations = table(spark, folder, "nation")
    people = table(spark, folder, "customer").join(
        nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"
    ).select("c_custkey", F.expr(_COUNTRY_TEXT).alias("country"))
    listed = nations.select(F.col("n_name").alias("name"), F.upper(F.substring(F.md5("n_name"), 1, 3)).alias("code"))
    return C.with_country_code(people, "country", listed).select("c_custkey", "country", "country_code")


# Names written badly: accents, one letter lost, two wrong, a region for a subdivision, no name at all.
_MISSPELT = (
    "CASE c_custkey % 7 WHEN 0 THEN replace(replace(n_name, 'A', 'Á'), 'I', 'ï') WHEN 1 THEN substr(n_name, 1, 2) || substr(n_name, 4) "
    "WHEN 2 THEN 'Q' || substr(n_name, 2, length(n_name) - 2) || 'q' WHEN 3 THEN ' ' || r_name WHEN 4 THEN substr(r_name, 2) "
    "WHEN 5 THEN reverse(n_name) ELSE lower(substr(n_name, 1, length(n_name) - 1)) || 'éé' END"
)


@query(
    "country_search",
    "WITH texts AS (SELECT c_custkey, " + _MISSPELT + " AS country FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
    "listed AS (SELECT lower(n_name) AS name, upper(substr(md5(n_name), 1, 3)) AS code, false AS second FROM nation "
    "UNION ALL SELECT lower(r_name), upper(substr(md5(r_name), 1, 3)), true FROM region), "
    "words AS (SELECT DISTINCT country, lower(strip_accents(trim(country))) AS word FROM texts), "
    "allowed AS (SELECT *, CASE WHEN length(word) >= 8 THEN 2 WHEN length(word) >= 4 THEN 1 ELSE 0 END AS typos FROM words), "
    "partial AS (SELECT country, arg_min(code, (name <> word, instr(name, word), code)) AS code FROM words, listed WHERE NOT second AND instr(name, word) > 0 GROUP BY country), "
    "near AS (SELECT country, arg_min(code, (levenshtein(word, name), second, name, code)) AS code FROM allowed, listed WHERE levenshtein(word, name) <= typos GROUP BY country), "
    "answers AS (SELECT w.country, coalesce(p.code, CASE word WHEN 'south kor' THEN 'KOR' WHEN 'st lucia' THEN 'LCA' END, n.code, 'ZZZ') AS country_code "
    "FROM words w LEFT JOIN partial p USING (country) LEFT JOIN near n USING (country)) SELECT c_custkey, country, country_code FROM texts JOIN answers USING (country)",
)
def country_search(spark, folder):
    """Countries with accents, letters lost or wrong, and regions in the place of subdivisions."""
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    people = table(spark, folder, "customer").join(places, "c_nationkey").select("c_custkey", F.expr(_MISSPELT).alias("country"))
    coded = lambda df, name: df.select(F.col(name).alias("name"), F.upper(F.substring(F.md5(name), 1, 3)).alias("code"))
    found = find_countries(people, "country", coded(nations, "n_name"), coded(regions, "r_name"))
    return found.select("c_custkey", "country", "country_code")


@query("birth_year", f"WITH {_parsed_sql()} SELECT \"case\", coalesce(year(date) - age, -1)::INT AS born FROM parsed")
def birth_year(spark, folder):
    people = W.parse_lines(answer_lines(spark, folder), answer_layout(spark, folder)[:5])
    return people.select("case", F.coalesce(C.birth_year(F.col("date"), F.col("age")), F.lit(-1)).alias("born"))


@query(
    "item_key_cleanup",
    "SELECT p_size::INT AS short, upper(substr(p_name, 1, 3)) AS key, substr(p_brand, 1, 1) AS sign, 'True' AS adjusted, p_type AS facet FROM part WHERE p_size % 5 <> 0",
)
def item_key_cleanup(spark, folder):
    """Key rows that carry a number; the sign is the first character."""
    keys = table(spark, folder, "part").select(
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_size").cast("string")).alias("short"),
        F.upper(F.substring("p_name", 1, 3)).alias("key"), F.col("p_brand").alias("sign"), F.col("p_type").alias("facet"),
    )
    return C.clean_item_key(keys, "short", "sign").select("short", "key", "sign", "adjusted", "facet")


@query(
    "valid_records",
    "SELECT doc_id AS uuid, toxic FROM labels WHERE quality = 1",
)
def valid_records(spark, folder):
    """The case number becomes the id; rows that are not flagged valid drop out."""
    records = table(spark, folder, "labels").withColumnsRenamed({"doc_id": "CASE", "quality": "IPC"})
    return C.valid_records(C.with_person_id(records)).select("uuid", "toxic")


# --- names ------------------------------------------------------------------------------------


def name_list(spark, folder):
    """``name, sex, year`` out of the parts; many names are listed more than once."""
    return table(spark, folder, "part").select(
        F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "M").otherwise("F").alias("sex"),
        (F.col("p_size") + 1937).cast("string").alias("year"),
    )


_NAMED = (
    "listed AS (SELECT p_size + 1937 AS year, CASE p_partkey % 2 WHEN 0 THEN 'M' ELSE 'F' END AS sex, p_name AS name FROM part), "
    "numbered AS (SELECT *, row_number() OVER (ORDER BY year, sex, name) - 1 AS n FROM listed), "
    "stretches AS (SELECT year, sex, min(n) AS f, count(*) AS c FROM numbered GROUP BY ALL), "
    "named AS (SELECT p.\"case\", m.name, p.sex, p.age, p.date, p.country FROM parsed p JOIN stretches s ON s.year = year(date) - age AND s.sex = p.sex "
    "JOIN numbered m ON m.n = f + ('0x' || substr(md5(p.\"case\" || ':0'), 1, 8))::BIGINT % c)"
)


@query("name_pick", f"WITH {_parsed_sql()}, {_NAMED} SELECT * FROM named")
def name_pick(spark, folder):
    """One random name per person out of those of the same sex and birth year."""
    people = W.parse_lines(answer_lines(spark, folder), answer_layout(spark, folder)[:5])
    return P.pick_names(people, name_list(spark, folder))


@query(
    "name_candidates",
    f"WITH {_parsed_sql()}, {_NAMED} SELECT s.year AS born, p.sex, count(*) AS people, any_value(c) AS names FROM parsed p JOIN stretches s "
    "ON s.year = year(date) - age AND s.sex = p.sex GROUP BY ALL",
)
def name_candidates(spark, folder):
    """People per birth year and sex beside the names that fit them: the multi-key join, pre-counted."""
    people = W.parse_lines(answer_lines(spark, folder), answer_layout(spark, folder)[:5])
    born = people.groupBy(C.birth_year(F.col("date"), F.col("age")).alias("born"), "sex").agg(F.count(F.lit(1)).alias("people"))
    names = name_list(spark, folder).groupBy(F.col("year").cast("int").alias("born"), "sex").agg(F.count(F.lit(1)).alias("names"))
    return born.join(names, ["born", "sex"])


@query(
    "header_lines",
    "SELECT p_name AS name, CASE p_partkey % 2 WHEN 0 THEN 'M' ELSE 'F' END AS sex, (p_size + 1937)::VARCHAR AS year FROM part",
)
def header_lines(spark, folder):
    """A list written with a header line, read as text with every copy of the header dropped."""
    path = write_csv(name_list(spark, folder), scratch_path(spark, "names"))
    return read_lines_without_header(spark, path, ["name", "sex", "year"])


# --- goals ------------------------------------------------------------------------------------

_TOPICS = ["adventure", "career", "financial", "health", "knowledge", "personal", "social", "spiritual"]


def goal_list(spark, folder):
    """``topic, goal``: the benchmark texts, dealt out over the eight topics."""
    topic = F.element_at(F.array(*[F.lit(t) for t in _TOPICS]), (F.col("item_id") % 8 + 1).cast("int"))
    return table(spark, folder, "benchmark").select(topic.alias("topic"), F.col("text").alias("goal"))


_QUINTILES = "q AS (SELECT id, " + ", ".join(
    "1 + " + " + ".join(f"(trunc({f}) >= quantile_disc({f}, 0.{2 * k}) OVER ())::INT" for k in range(1, 5)) + f" AS {f}_Q" for f in S.FACTORS
) + " FROM users)"


def _hash_sql(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(f"({p})::VARCHAR" for p in parts) + "), 1, 8))::BIGINT"


def _goals_sql() -> str:
    topics_of = " ".join(f"WHEN '{f}' THEN [{', '.join(repr(t) for t in ts)}]" for f, ts in P.TOPICS_OF.items())
    high = ", ".join(f"CASE WHEN {f}_Q > 3 THEN '{f}' END" for f in S.FACTORS)
    best = ", ".join(f"{{'r': -{f}_Q, 'f': '{f}'}}" for f in S.FACTORS)
    steps = []
    for d in range(P.MOST_GOALS):
        number = f"({_hash_sql('id', '0', str(d))} % (pool - {d}))"
        shift = number
        for n in range(1, d + 1):
            shift = f"({shift} + (CASE WHEN {shift} >= t{d}[{n}] THEN 1 ELSE 0 END))"
        steps.append(
            f"d{d} AS (SELECT * EXCLUDE (t{d}), CASE WHEN cnt > {d} THEN list_sort(list_append(t{d}, {shift})) ELSE t{d} END AS t{d + 1} FROM "
            + ("base" if d == 0 else f"d{d - 1}") + ")"
        )
    topic_list = "[" + ", ".join(repr(t) for t in _TOPICS) + "]"
    return (
        f"WITH {USER_SCORES}, {_QUINTILES}, goals AS (SELECT {topic_list}[item_id % 8 + 1] AS topic, text AS goal FROM benchmark), "
        "listed AS (SELECT topic, goal, row_number() OVER (PARTITION BY topic ORDER BY goal) - 1 AS p, count(*) OVER (PARTITION BY topic) AS n FROM goals), "
        f"f AS (SELECT id, list_filter([{high}], lambda x: x IS NOT NULL) AS high, list_sort([{best}])[1].f AS best FROM q), "
        f"t AS (SELECT id, unnest(list_distinct(flatten(list_transform(CASE WHEN len(high) > 0 THEN high ELSE [best] END, lambda x: CASE x {topics_of} END)))) AS topic FROM f), "
        "s AS (SELECT t.id, t.topic, n, coalesce(sum(n) OVER (PARTITION BY id ORDER BY t.topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start "
        "FROM t JOIN (SELECT DISTINCT topic, n FROM listed) z ON z.topic = t.topic), "
        f"base AS (SELECT id, sum(n)::BIGINT AS pool, least(1 + {_hash_sql('id', '0', chr(39) + 'count' + chr(39))} % 5, sum(n)::BIGINT) AS cnt, []::BIGINT[] AS t0 FROM s GROUP BY id), "
        + ", ".join(steps)
        + f", picks AS (SELECT id, unnest(t{P.MOST_GOALS}) AS pos FROM d{P.MOST_GOALS - 1}), "
        "got AS (SELECT picks.id, pos, s.topic, goal FROM picks JOIN s ON s.id = picks.id AND pos >= start AND pos < start + n JOIN listed l ON l.topic = s.topic AND l.p = pos - start)"
    )


@query("assign_goals", _goals_sql() + " SELECT id, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::INT AS place, goal FROM got")
def assign_goals(spark, folder):
    """Goals drawn from the topics that suit a person's high factors."""
    scored = S.with_quintiles(user_scores(spark, folder), S.FACTORS)
    people = P.assign_goals(scored, goal_list(spark, folder))
    return people.select("id", F.posexplode("goals").alias("place", "goal"))


@query("goal_text", _goals_sql() + " SELECT id, string_agg(goal, '|' ORDER BY pos) AS goals, count(*)::INT AS goal_count FROM got GROUP BY id")
def goal_text(spark, folder):
    """The goal list as one delimited text, written as CSV, read back and split again."""
    scored = S.with_quintiles(user_scores(spark, folder), S.FACTORS)
    people = P.assign_goals(scored, goal_list(spark, folder)).select("id", array_to_text(F.col("goals")).alias("goals"))
    path = scratch_path(spark, "goals")
    people.write.option("header", True).option("escape", '"').csv(path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="id long, goals string")
    return back.select("id", "goals", F.size(text_to_array(F.col("goals"))).alias("goal_count"))
