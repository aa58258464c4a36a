"""Queries for names, channels, files, logs and sets."""

from pyspark.sql import functions as F

from epochal.operators import channels, ordering, splits, training
from epochal.plans.registry import query
from epochal.sources import tables as t

#: Channel specifications by customer number, for queries on names.
SPECS = ("C3==eeg", "E1", "Chin1-Chin2 == EMG", "O2", "ECG II", "Flow")
THERE = ("C3", "C4", "E1", "O2", "ECG II")


def specs(spark, sf_dir):
    spec = F.element_at(F.array(*map(F.lit, SPECS)), (F.col("c_custkey") % len(SPECS)).cast("int") + 1)
    return t.table(spark, sf_dir, "customer").select("c_custkey", spec.alias("spec"))


SPEC_SQL = "specs AS (SELECT c_custkey, (['C3==eeg', 'E1', 'Chin1-Chin2 == EMG', 'O2', 'ECG II', 'Flow'])[c_custkey % 6 + 1] AS spec FROM customer)"
NAME_SQL = "trim(split_part(spec, '==', 1))"


@query(f"""WITH {SPEC_SQL} SELECT c_custkey, {NAME_SQL} AS name, CASE WHEN contains(spec, '==') THEN upper(trim(split_part(spec, '==', 2)))
WHEN regexp_matches(upper({NAME_SQL}), '^(E1|E2|EOG|ROC|LOC)') THEN 'EOG' WHEN regexp_matches(upper({NAME_SQL}), '^(ECG|EKG)') THEN 'ECG'
WHEN regexp_matches(upper({NAME_SQL}), '^(CHIN|EMG)') THEN 'EMG' WHEN regexp_matches(upper({NAME_SQL}), '^(C|F|O|P|T|EEG)') THEN 'EEG' END AS type FROM specs""")
def type_parse(spark, sf_dir):
    return specs(spark, sf_dir).select("c_custkey", channels.name_of(F.col("spec")).alias("name"), channels.type_of(F.col("spec")).alias("type"))


@query(f"WITH {SPEC_SQL} SELECT c_custkey, CASE {NAME_SQL} WHEN 'C3' THEN 'C3-A2' WHEN 'O2' THEN 'O2-A1' ELSE {NAME_SQL} END AS name FROM specs")
def auto_reference(spark, sf_dir):
    name = channels.name_of(F.col("spec"))
    reference = channels.reference_of(name)
    return specs(spark, sf_dir).select("c_custkey", F.when(reference.isNotNull(), F.concat(name, F.lit("-"), reference)).otherwise(name).alias("name"))


@query(f"WITH {SPEC_SQL} SELECT c_custkey, CASE WHEN {NAME_SQL} IN ('C3', 'C4', 'E1', 'O2', 'ECG II') THEN {NAME_SQL} ELSE 'C4' END AS name FROM specs")
def fallback_channels(spark, sf_dir):
    there = F.array(*map(F.lit, THERE))
    return specs(spark, sf_dir).select("c_custkey", channels.first_available(F.array(channels.name_of(F.col("spec")), F.lit("C4")), there).alias("name"))


@query(f"""WITH {SPEC_SQL}, a AS (SELECT c_custkey, list_filter([{NAME_SQL}, 'C3', 'F3'], lambda c: list_contains(['C3', 'C4', 'E1', 'O2', 'ECG II'], c)) AS f FROM specs)
SELECT c_custkey, array_to_string(f, '+') AS found FROM a WHERE len(f) > 0""")
def avail_channels(spark, sf_dir):
    found = channels.available(F.array(channels.name_of(F.col("spec")), F.lit("C3"), F.lit("F3")), F.array(*map(F.lit, THERE)))
    return specs(spark, sf_dir).select("c_custkey", found.alias("f")).filter(F.size("f") > 0).select("c_custkey", F.array_join("f", "+").alias("found"))


@query("SELECT n_nationkey, c AS combination FROM nation, (VALUES ('C3+E1'), ('C3+C4'), ('C4+E1')) v(c)")
def channel_combos(spark, sf_dir):
    """C3 or C4 with E1 or C3, each set of channels once: C3+C3 is C3 alone and goes."""
    combos = [c for c in splits.channel_combinations([["C3", "C4"], ["E1", "C3"]]) if len(set(c)) == 2]
    names = ["+".join(sorted(c)) for c in combos]
    return t.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, names))).alias("combination"))


#: Channels that a study may have, by the numbers of its events.
NAMES = ("C3", "C4", "O2", "E1", "E2", "A1", "M2", "F3")


def study_channels(spark, sf_dir):
    """study_id, names: the channels that each study has, in the order of their names. A study has a handful, whatever its events."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod("event_id", F.lit(len(NAMES) + 3)) + 1).cast("int"))
    events = t.table(spark, sf_dir, "events").filter(F.pmod("event_id", F.lit(len(NAMES) + 3)) < len(NAMES))
    return events.groupBy(F.col("user_id").alias("study_id")).agg(F.array_sort(F.collect_set(name)).alias("names"))


STUDY_CHANNELS = "channels AS (SELECT DISTINCT user_id AS study_id, (['C3', 'C4', 'O2', 'E1', 'E2', 'A1', 'M2', 'F3'])[event_id % 11 + 1] AS name FROM events WHERE event_id % 11 < 8)"


@query(f"""WITH {STUDY_CHANNELS}, rules(name, mastoid) AS (VALUES ('C3', 'M2'), ('C4', 'A1'), ('O2', 'A1'), ('F3', 'M2'))
SELECT c.study_id, string_agg(CASE WHEN m.name IS NULL THEN c.name ELSE concat(c.name, '-', m.name) END, '+' ORDER BY c.name) AS loaded
FROM channels c LEFT JOIN rules r ON c.name = r.name LEFT JOIN channels m ON m.study_id = c.study_id AND m.name = r.mastoid WHERE c.name NOT IN ('A1', 'M2') GROUP BY 1""")
def study_references(spark, sf_dir):
    """References by the mastoids that a study has; studies with no other channels load nothing."""
    loaded = channels.referenced(F.col("names"))
    return study_channels(spark, sf_dir).select("study_id", loaded.alias("l")).filter(F.size("l") > 0).select("study_id", F.array_join("l", "+").alias("loaded"))


@query(f"""WITH {STUDY_CHANNELS}, pairs AS (SELECT a.study_id, a.name AS a, b.name AS b, row_number() OVER (PARTITION BY a.study_id, least(a.name, b.name), greatest(a.name, b.name)
ORDER BY a.name, b.name) AS nth FROM channels a JOIN channels b ON a.study_id = b.study_id WHERE a.name IN ('C3', 'C4', 'E1') AND b.name IN ('C3', 'E1', 'E2'))
SELECT study_id, concat(a, '+', b) AS combination FROM pairs WHERE nth = 1""")
def study_combos(spark, sf_dir):
    """Every choice of one channel of each group, of those that the study has."""
    groups = F.array(*(F.array_intersect("names", F.array(*map(F.lit, group))) for group in (("C3", "C4", "E1"), ("C3", "E1", "E2"))))
    chosen = study_channels(spark, sf_dir).select("study_id", F.explode(channels.combinations(groups)).alias("c"))
    return chosen.select("study_id", F.array_join("c", "+").alias("combination"))


@query("SELECT n_regionkey, array_to_string(list_sort(list_distinct(list(left(n_name, 1)))), ',') AS channels FROM nation GROUP BY 1")
def distinct_channels(spark, sf_dir):
    groups = t.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.array(F.left("n_name", F.lit(1)))).alias("groups"))
    return groups.select("n_regionkey", F.array_join(F.array_sort(channels.distinct_channels(F.col("groups"))), ",").alias("channels"))


@query("SELECT p_brand AS channel, count(*) AS n, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1")
def channel_catalog(spark, sf_dir):
    return t.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("channel")).agg(F.count("*").alias("n"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def skip_done(spark, sf_dir):
    done = t.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def dataset_filter(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", "source").filter(F.col("source").isin("src1", "src3"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^[a-z]+://')")
def file_regex(spark, sf_dir):
    """Rows discovered by a pattern on their path, with the part that it captures."""
    return t.table(spark, sf_dir, "pages").filter(F.col("url").rlike("^[a-z]+://")).select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY CAST(right(c_name, 9) AS INTEGER)) AS nth FROM customer")
def numeric_sort(spark, sf_dir):
    number = F.expr("cast(right(c_name, 9) as int)")
    rows = t.table(spark, sf_dir, "customer").select("c_custkey", number.alias("number"))
    return ordering.running_by_number(rows, "nth", F.lit(1).cast("long"), "number").select("c_custkey", "nth")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name LIMIT 10")
def first_n(spark, sf_dir):
    return t.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_name").limit(10)


def model_files(spark, sf_dir):
    name = F.concat(F.lit("@epoch_"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "_val_dice_0.").otherwise("_val_loss_0."), F.lpad((F.col("s_suppkey") * 37 % 97).cast("string"), 2, "0"), F.lit(".h5"))
    return t.table(spark, sf_dir, "supplier").select(name.alias("file"))


FILES = "files AS (SELECT concat('@epoch_', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '_val_dice_0.' ELSE '_val_loss_0.' END, lpad(CAST(s_suppkey * 37 % 97 AS VARCHAR), 2, '0'), '.h5') AS file FROM supplier)"


@query(f"""WITH {FILES}, s AS (SELECT file, TRY_CAST(regexp_extract(file, '_val_dice_([0-9]+[.][0-9]+)', 1) AS DOUBLE) AS dice FROM files)
SELECT max_by(file, dice) AS best, (SELECT max_by(file, CAST(regexp_extract(file, 'epoch_([0-9]+)', 1) AS INTEGER)) FROM files) AS latest FROM s WHERE dice IS NOT NULL""")
def top_model(spark, sf_dir):
    files = model_files(spark, sf_dir)
    best, latest = training.best_model(files), training.last_model(files)
    return best.select(F.col("file").alias("best"), F.lit(1).alias("k")).join(latest.select(F.col("file").alias("latest"), F.lit(1).alias("k")), "k").drop("k")


def log(spark, sf_dir):
    """A training log of runs of 40 epochs."""
    return t.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("rn"), (F.col("s_suppkey") % 40).cast("int").alias("epoch"), F.round(F.col("s_acctbal"), 2).alias("learning_rate"))


LOG = "log AS (SELECT CAST(s_suppkey AS INTEGER) AS rn, CAST(s_suppkey % 40 AS INTEGER) AS epoch, round(s_acctbal, 2) AS learning_rate FROM supplier), last AS (SELECT * FROM log WHERE rn >= (SELECT max(rn) FROM log WHERE epoch = 0))"


@query(f"WITH {LOG} SELECT rn, epoch, learning_rate FROM last")
def last_run(spark, sf_dir):
    return training.last_run(log(spark, sf_dir))


@query(f"WITH {LOG} SELECT max(learning_rate) FILTER (WHERE epoch = 5) AS at_epoch, max_by(learning_rate, rn) AS latest FROM last")
def lr_lookup(spark, sf_dir):
    return training.rate_at(log(spark, sf_dir), 5)


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, CAST(ceil((least(n * 100, 3000) // 5) / 64.0) AS BIGINT) AS steps FROM n")
def steps(spark, sf_dir):
    sizes = t.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sizes.select("source", training.steps(F.col("n") * 100, 3000, 2, 64).alias("steps"))


@query("""WITH RECURSIVE f(p_partkey, depth, k, field, jump) AS (SELECT p_partkey, 0, CAST(p_size % 7 + 3 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM part
UNION ALL SELECT p_partkey, depth + 1, k, field + (k - 1) * jump, jump * 2 FROM f WHERE depth < 6) SELECT p_partkey, CAST(field AS BIGINT) AS field FROM f WHERE depth = 6""")
def receptive_field(spark, sf_dir):
    layer = F.struct((F.col("p_size") % 7 + 3).alias("kernel"), F.lit(2).alias("stride"), F.lit(1).alias("dilation"))
    return t.table(spark, sf_dir, "part").select("p_partkey", training.receptive_field(F.array_repeat(layer, 6)).alias("field"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) / 10 * 30 AS seconds FROM part")
def pred_period(spark, sf_dir):
    """Seconds that a prediction covers: data per prediction over data per period, times 30."""
    return t.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("double") / 10 * 30).alias("seconds"))


@query("""WITH w AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY 1, 2)
SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY 1""")
def ordered_distinct(spark, sf_dir):
    """Distinct entries of a list, in the order of their first occurrence."""
    return t.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("SELECT CAST(c_custkey AS BIGINT) AS key, c_mktsegment AS segment, '~' AS status FROM customer UNION ALL SELECT o_orderkey, '~', o_orderstatus FROM orders")
def outer_concat(spark, sf_dir):
    """Rows of tables with different columns, absent ones marked."""
    a = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    b = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select(*sorted(both.columns)).fillna("~", ["segment", "status"])


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN ('src0', 'src7')")
def drop_named(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("source").distinct().filter(~F.col("source").isin("src0", "src7"))


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 40")
def set_overlap(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    return e.filter("event_type = 'error'").select("user_id").intersect(e.filter("event_type = 'signup' and value > 40").select("user_id"))


@query("""WITH a AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS types FROM events GROUP BY 1)
SELECT user_id, types = ['click', 'error', 'purchase', 'signup', 'view'] AS equal FROM a""")
def type_set_equality(spark, sf_dir):
    """Whether the found types are just the requested ones: neither side has any that the other lacks."""
    asked = F.array(*map(F.lit, t.STAGES))
    found = t.table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    both = (F.size(F.array_except("types", asked)) == 0) & (F.size(F.array_except(asked, "types")) == 0)
    return found.select("user_id", both.alias("equal"))


@query("SELECT truth FROM (SELECT quality AS truth FROM labels UNION SELECT toxic FROM labels) WHERE truth <> 9")
def label_set(spark, sf_dir):
    """The labels on either side but the ignored ones."""
    l = t.table(spark, sf_dir, "labels")  # noqa: E741
    return l.select(F.col("quality").alias("truth")).union(l.select("toxic")).distinct().filter("truth <> 9")
