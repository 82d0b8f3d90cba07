"""Queries of sources, sinks, administration and reports, each beside its SQL. What a sink writes is read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import administer as A
from ..operators import choices as C
from ..operators import cohort as H
from ..operators import design as G
from ..operators import ranking as R
from ..operators import summary as Y
from ..schemas import BASELINE, CONDITION, FIELDS, OTHER, PAIR
from ..session import fresh
from ..sources import banks, batches, fixture, records, reports
from ..sources import lines as jsonl
from ..streaming import ingest
from . import oracle as Q
from . import registry as P
from .query import Query

COND, PAIRS = " ".join(CONDITION), " ".join(PAIR)


def orders(spark, d):
    return fixture.table(spark, d, "orders")


def written(spark, lines, name):
    path = fresh(spark, name)
    lines.write.text(path)
    return path


# record store


def as_records(x):
    """Stored records of choices: the letters from the printed positions."""
    at = lambda k: F.when(F.col("pos_a") == k, F.col("a")).when(F.col("pos_b") == k, F.col("b")).when(F.col("pos_none") == k, "no_preference")
    options = F.map_from_arrays(T.letters(F.col("n_options")), F.slice(F.array(at(1), at(2), at(3)), F.lit(1), F.col("n_options")))
    chosen = F.when(F.col("chose_a"), F.col("a")).when(F.col("chose_b"), F.col("b")).when(F.col("chose_none"), "no_preference").otherwise("")
    has = {"model_id": "model", "welfare_qvar": "qvar", "welfare_object": "object", "welfare_subject": "subject", "no_preference_offered": "no_pref_offered", "entity_a": "a", "entity_b": "b", "refusal_flag": "refused"}
    own = {k: F.col(v) for k, v in has.items()} | {"module": F.lit("welfare"), "welfare_probe": F.lit("choice"), "welfare_options": options, "welfare_choice": chosen}
    return x.select(*[own.get(n, F.lit(v)).cast(t).alias(n) for n, t, v in FIELDS])


def record_store(spark, d):
    path = fresh(spark, "records")
    rows = as_records(fixture.choices(spark, d))
    records.write_records(rows, path)
    records.write_records(rows.limit(5).withColumn("module", F.lit("battery")), path)
    return C.from_records(records.read_records(spark, path, "welfare"))


def tolerant(spark, d):
    x = orders(spark, d)
    whole = F.to_json(F.struct(F.concat(F.lit("M"), F.col("o_custkey") % 5).alias("model_id"), F.col("o_orderpriority").alias("notes"), F.lit(1).alias("not_a_field")))
    lines = x.select(F.when(F.col("o_orderkey") % 7 == 0, F.substring(whole, 1, 12)).when(F.col("o_orderkey") % 11 == 0, '{"notes": ""}').otherwise(whole).alias("value"))
    return records.read_records(spark, written(spark, lines, "lines"), strict=False).groupBy("model_id", "module").agg(F.count("*").alias("n"))


TOLERANT = "select 'M' || (o_custkey % 5) as model_id, 'battery' as module, count(*) as n from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 group by 1"


def scan_places(spark, d):
    """Two files of lines, some cut off and some without a key field, read in ranges: records with their places."""
    x, k = orders(spark, d), F.col("o_orderkey")
    whole = F.concat(F.lit('{"model_id":"M'), F.col("o_custkey") % 5, F.lit('","item_id":"i","framing":"self","reasoning_mode":"r","response_format":"f","item_context":"c","paraphrase_id":"w0","method":"sample","trial_idx":1,"record_id":"'), k, F.lit('","notes":"é'), "o_orderpriority", F.lit('"}'))
    x = x.withColumn("value", F.when(k % 7 == 0, F.substring(whole, 1, 30)).when(k % 11 == 0, F.replace(whole, F.lit('"item_id":"i",'), F.lit(""))).otherwise(whole))
    paths = []
    for part in (0, 1):
        own = x.where(F.col("o_custkey") % 2 == part).repartitionByRange(1, "o_orderkey").sortWithinPartitions("o_orderkey").select("value")
        paths.append(written(spark, own, "places"))
    got = jsonl.scan(spark, paths, strict=False, size=50_000, places=True)
    return got.select("model_id", "record_id", "notes", "module", F.col("seq.path").alias("path"), F.col("seq.offset").alias("at_byte"), "line")


SCAN_PLACES = """with w as (select *, '{"model_id":"M' || (o_custkey % 5) || '","item_id":"i","framing":"self","reasoning_mode":"r","response_format":"f","item_context":"c","paraphrase_id":"w0","method":"sample","trial_idx":1,"record_id":"' || o_orderkey || '","notes":"é' || o_orderpriority || '"}' as whole from orders),
v as (select *, case when o_orderkey % 7 = 0 then substr(whole, 1, 30) when o_orderkey % 11 = 0 then replace(whole, '"item_id":"i",', '') else whole end as value, o_custkey % 2 as path from w),
p as (select *, row_number() over o as line, coalesce(sum(strlen(value) + 1) over (partition by path order by o_orderkey rows between unbounded preceding and 1 preceding)  , 0) as at_byte from v window o as (partition by path order by o_orderkey))
--
select 'M' || (o_custkey % 5) as model_id, o_orderkey::varchar as record_id, 'é' || o_orderpriority as notes, 'battery' as module, path, at_byte, line from p where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0"""


def results(spark, d):
    x, k, c = orders(spark, d), F.col("o_orderkey"), F.col
    ident = F.concat(F.lit("k"), c("o_custkey").cast("string"), F.lit("-"), k.cast("string")).alias("custom_id")
    one = F.struct(ident, F.struct(F.when(k % 5 == 0, "errored").otherwise("succeeded").alias("type"), F.when(k % 5 == 0, F.struct(F.lit("late").alias("message"))).alias("error"), F.when(k % 5 != 0, F.struct(F.when(k % 3 == 0, "refusal").otherwise("end_turn").alias("stop_reason"), F.array(F.struct(F.lit("text").alias("type"), c("o_orderpriority").alias("text"))).alias("content"))).alias("message")).alias("result"))
    choice = F.struct(F.struct(c("o_orderstatus").alias("content")).alias("message"), F.when(k % 3 == 0, "content_filter").otherwise("stop").alias("finish_reason"))
    two = F.struct(ident, F.struct(F.when(k % 5 == 0, 429).otherwise(200).alias("status_code"), F.struct(F.when(k % 5 != 0, F.array(choice)).alias("choices")).alias("body")).alias("response"))
    lines = x.select(F.when(c("o_custkey") % 2 == 0, F.to_json(one)).otherwise(F.to_json(two)).alias("value"))
    return records.decoded(spark.read.text(written(spark, lines, "results")))


RESULTS = """with r as (select 'k' || o_custkey || '-' || o_orderkey as custom_id, o_custkey % 2 = 0 as one, o_orderkey % 5 = 0 as bad, o_orderkey % 3 = 0 as no, o_orderpriority, o_orderstatus from orders)
--
select custom_id, case when bad then '' when one then o_orderpriority else o_orderstatus end as text, case when bad then case when one then 'errored: {"message":"late"}' else 'http 429: {}' end end as error, no and not bad as refused from r"""


SPECS = (("AUTOMOBILE", "auto-1", "claude-4.5", 0.7, 16), ("BUILDING", "build-1", "claude-4.6", 0.5, 16), ("FURNITURE", "furn-1", "claude-5", 1.0, 8), ("HOUSEHOLD", "house-1", "gpt-5.6", 1.0, 16), ("MACHINERY", "mach-1", "gpt-5", 1.0, 32))


def provider_lines(cells):
    """A results file for rendered cells, of both providers' shapes: errors, declines, strays, prose, refusals, letters."""
    c, draw = F.col, F.conv(F.substring("cell_key", 1, 4), 16, 10).cast("int")
    kind = draw % 12
    ident = F.when(kind == 2, F.concat(F.lit("x"), "cell_key")).otherwise(c("cell_key")).alias("custom_id")
    text = F.when(kind == 1, "no").when(kind == 3, "hmm").when(kind == 4, "As an AI, I cannot choose").when(kind == 5, "ANSWER: B").otherwise("A")
    content = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    message = F.when(kind != 0, F.struct(F.when(kind == 1, "refusal").otherwise("end_turn").alias("stop_reason"), content.alias("content")))
    one = F.struct(ident, F.struct(F.when(kind == 0, "errored").otherwise("succeeded").alias("type"), F.when(kind == 0, F.struct(F.lit("late").alias("message"))).alias("error"), message.alias("message")).alias("result"))
    choice = F.struct(F.struct(text.alias("content")).alias("message"), F.when(kind == 1, "content_filter").otherwise("stop").alias("finish_reason"))
    two = F.struct(ident, F.struct(F.when(kind == 0, 429).otherwise(200).alias("status_code"), F.struct(F.when(kind != 0, F.array(choice)).alias("choices")).alias("body")).alias("response"))
    return cells.select(F.when(draw % 2 == 0, F.to_json(one)).otherwise(F.to_json(two)).alias("value"))


def api_specs(spark):
    rows = spark.createDataFrame([*SPECS], "model string, ref string, generation string, temperature double, max_tokens int")
    rest = {"family": "string", "released": "date", "kind": "string", "quant_format": "string", "quant": "string", "backend": "string", "in_window": "boolean", "reasoning_control": "string", "thinks_by_default": "boolean"}
    return rows.withColumns({k: F.lit(None).cast(v) for k, v in rest.items()})


def collect_fold(spark, d):
    """A results file folded twice under the same id: records are there once, as they are read back, beside the tally."""
    cells, store = G.rendered(P.design_cells(spark, d)), fresh(spark, "collected")
    lines = spark.read.text(written(spark, provider_lines(cells), "results"))
    for _ in range(2):
        tally = batches.collect(lines, "file 1", cells, batches.prepared(api_specs(spark), "params"), store)
    x = records.read_records(spark, store, "welfare")
    by = x.groupBy(F.col("model_id").alias("model"), F.col("welfare_qvar").alias("qvar"), "temperature", "reasoning_applied").agg(
        F.count("*").alias("n"), F.count_if(records.is_error(F.col("notes"))).alias("n_errors"), F.count_if(F.col("notes") == batches.DECLINED).alias("n_declined"), F.count_if("refusal_flag").alias("n_refused"), F.count_if("parse_failed").alias("n_failed"),
        F.count_if(F.col("welfare_choice") == F.col("entity_a")).alias("n_a"), F.count("modal_rating").alias("n_modal"), F.countDistinct(records.record_key()).alias("n_cells"),
    )
    return by.withColumns({k: F.lit(v) for k, v in tally.items()})


#: What the answers of provider_lines() mean, by the cell.
ANSWERED = f"""{Q.ASKED},
spec(model, ref, generation, temperature, max_tokens) as (values {', '.join(str(s) for s in SPECS)}),
k as (select *, ('0x' || substr(cell_key, 1, 4))::int % 12 as kind from asked),
ans as (select *, kind = 0 as err, kind = 1 as declined, kind in (1, 4) as refused, kind in (0, 1, 3, 4) as failed, case when kind in (0, 1, 3, 4) then '' else me[p[case when kind = 5 then 2 else 1 end] + 1] end as choice from k where kind <> 2)"""
COLLECT_FOLD = f"""with {ANSWERED}
--
select model, qvar, case when generation = 'claude-5' then 1.0 else temperature end as temperature, case when generation = 'claude-4.5' then 'omitted(off)' else 'disabled' end as reasoning_applied, count(*) as n, count(*) filter (where err) as n_errors, count(*) filter (where declined) as n_declined,
  count(*) filter (where refused) as n_refused, count(*) filter (where failed) as n_failed, count(*) filter (where choice = a) as n_a, count(*) filter (where not failed) as n_modal, count(*) as n_cells,
  (select count(*) from ans) as rows, (select count(*) from ans where err) as errors, (select count(*) from ans where refused) as refusals, (select count(*) from ans where failed and not err and not declined) as parse_failures, (select count(*) from k where kind = 2) as unmatched
  from ans join spec using (model) group by all"""

# requests



def requested(spark, d, style):
    return records.requests(G.rendered(P.design_cells(spark, d)), style, api_specs(spark))


REQUESTS = f"""{Q.ASKED},
spec(model, ref, generation, temperature, max_tokens) as (values {', '.join(str(s) for s in SPECS)}),
j as (select *, '"role":"user","content":"' || replace(user_, chr(10), '\\n') || '"' as said from asked join spec using (model)),
req as (select 'params' as style, model, cell_key, '{{"custom_id":"' || cell_key || '","params":{{"model":"' || ref || '","max_tokens":' || max_tokens || ',"messages":[{{' || said || '}}],"system":"' || system || '"'
    || case when generation = 'claude-5' then '' else ',"temperature":' || temperature::double end || case when generation = 'claude-4.5' then '' else ',"thinking":{{"type":"disabled"}}' end || case when generation = 'claude-5' then ',"output_config":{{"effort":"low"}}' else '' end || '}}}}' as line from j
  union all select 'body', model, cell_key, '{{"custom_id":"' || cell_key || '","method":"POST","url":"/v1/chat/completions","body":{{"model":"' || ref || '","messages":[{{"role":"system","content":"' || system || '"}},{{' || said || '}}],"max_completion_tokens":' || max_tokens
    || ',"reasoning_effort":"' || case when generation = 'gpt-5.6' then 'none' else 'minimal' end || '"}}}}' from j)"""


def request_lines(spark, d):
    both = [requested(spark, d, s).withColumn("style", F.lit(s)) for s in ("params", "body")]
    return both[0].unionByName(both[1]).withColumn("digest", F.md5("line")).withColumn("size", F.octet_length("line"))


def request_shards(spark, d):
    return batches.sharded(requested(spark, d, "body"), 5000, 3_000_000).groupBy("model", "shard").agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.min("cell_key").alias("first_key"))


#: Steps over shards, not rows: each begins at the first line that would break a cap of the one before.
REQUEST_SHARDS = f"""with recursive {REQUESTS},
l as (select model, cell_key, strlen(line) + 1 as own, row_number() over (partition by model order by cell_key) as r, sum(strlen(line) + 1) over (partition by model order by cell_key) as cum from req where style = 'body'),
t(model, shard, s, before) as (select distinct model, 0, 1::bigint, 0::hugeint from l
  union all select * from (select t.model, t.shard + 1, min(l.r), min(l.cum - l.own) from t join l on l.model = t.model and l.r > t.s and (l.r - t.s >= 5000 or l.cum - t.before > 3000000) group by t.model, t.shard)),
e as (select *, lead(s) over (partition by model order by shard) as z from t)
--
select e.model, shard, count(*) as n, sum(own) as bytes, min(cell_key) as first_key from e join l on l.model = e.model and l.r >= e.s and (z is null or l.r < z) group by 1, 2"""


def request_files(spark, d):
    """Files and sidecars of what a store leaves to ask, read back: a row a file."""
    cells, store, folder = G.rendered(P.design_cells(spark, d)), fresh(spark, "collected"), fresh(spark, "requests")
    some = cells.where(F.conv(F.substring("cell_key", 5, 2), 16, 10).cast("int") < 64)
    batches.collect(provider_lines(some), "first", cells, batches.prepared(api_specs(spark), "params"), store)
    batches.build(cells, api_specs(spark), "params", folder, store, "hash", "api", (4000, 2_500_000))
    lines = spark.read.text(f"{folder}/*.batch.jsonl").withColumn("file", F.col("_metadata.file_name"))
    files = lines.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.min(F.get_json_object("value", "$.custom_id")).alias("first_key"), F.max(F.get_json_object("value", "$.custom_id")).alias("last_key"))
    meta = spark.read.option("multiLine", True).json(f"{folder}/*.meta.json")
    meta = meta.select("*", F.explode("files").alias("f")).where("f.requests >= 0").select(*[c for c in batches.SIDECAR if c not in ("files", "generated_at")], F.col("f.path").alias("file"), (F.to_timestamp("generated_at").isNotNull()).alias("dated"), (F.col("f.requests")).alias("listed"), F.col("f.bytes").alias("listed_bytes"))
    return files.join(meta, "file").withColumn("max_tokens", F.col("max_tokens").cast("long"))


REQUEST_FILES = f"""with recursive {REQUESTS},
done as (select cell_key from (select *, ('0x' || substr(cell_key, 1, 4))::int % 12 as kind from asked where ('0x' || substr(cell_key, 5, 2))::int < 64) where kind not in (0, 2)),
l as (select req.model, cell_key, strlen(line) + 1 as own, row_number() over w as r, sum(strlen(line) + 1) over w as cum from req where style = 'params' and cell_key not in (select cell_key from done) window w as (partition by req.model order by cell_key)),
t(model, shard, s, before) as (select distinct model, 0, 1::bigint, 0::hugeint from l
  union all select * from (select t.model, t.shard + 1, min(l.r), min(l.cum - l.own) from t join l on l.model = t.model and l.r > t.s and (l.r - t.s >= 4000 or l.cum - t.before > 2500000) group by t.model, t.shard)),
e as (select *, lead(s) over (partition by model order by shard) as z, count(*) over (partition by model) as of from t),
f as (select e.model, shard, of, count(*) as n, sum(own) as bytes, min(cell_key) as first_key, max(cell_key) as last_key from e join l on l.model = e.model and l.r >= e.s and (z is null or l.r < z) group by all),
c as (select model, count(*) as planned from asked group by 1)
--
select model || '.params' || case when of > 1 then '.part' || printf('%02d', (shard + 1)::int) else '' end || '.batch.jsonl' as file, n, bytes, n as listed, bytes as listed_bytes, first_key, last_key, model as model_id, ref as model_ref, 'api' as backend, '/v1/messages' as endpoint, 'welfare' as module, 'hash' as config_hash,
  planned as cells_planned, planned - sum(n) over (partition by model) as cells_skipped_already_done, sum(n) over (partition by model) as requests_written, case when generation = 'claude-4.5' then 'omitted(off)' else 'disabled' end as reasoning_applied, true as reasoning_standardized,
  max_tokens, case when generation <> 'claude-5' then temperature end as temperature_sent, case when generation = 'claude-5' then 1.0 else temperature end as temperature_recorded, true as dated from f join spec using (model) join c using (model)"""

# administration


def administered(spark, d):
    return A.run(G.rendered(P.design_cells(spark, d)), None)


ADMINISTERED = f"""{Q.ASKED},
h as (select *, list_transform(string_split(sha256(question || chr(10) || options), ''), lambda d: instr('0123456789abcdef', d) - 1) as h0 from asked),
placed as (select *, (case when no_pref_offered then list_sum(h0) % 3 else h0[64] % 2 end)::int + 1 as position from h),
adm as (select *, me[p[position] + 1] as choice from placed)"""


def full_records(spark, d):
    """Records as they would be stored, read back and keyed again."""
    specs = banks.administered(registered(spark)).withColumnRenamed("model", "m").withColumn("model", F.upper("m")).drop("m")
    path = fresh(spark, "full")
    records.write_records(A.full_record(administered(spark, d), specs), path)
    return records.read_records(spark, path).withColumn("cell_key", records.record_key())


def tallied(spark, d):
    x = orders(spark, d).select(F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderkey") % 9 == 0, "error: late").otherwise("").alias("notes"), (F.col("o_orderkey") % 5 == 0).alias("refused"), (F.col("o_orderkey") % 5 < 2).alias("parse_failed"), ((F.col("o_custkey") % 10).cast("double") / 10).alias("option_mass_coverage"))
    return A.tallies(x)


TALLIES = "select o_orderpriority as model, count(*) as written, count(*) filter (where o_orderkey % 9 = 0) as errors, count(*) filter (where o_orderkey % 5 = 0) as refusals, count(*) filter (where o_orderkey % 5 = 1) as parse_failures, count(*) filter (where o_custkey % 10 < 5) as low_coverage from orders group by 1"


def first_rows(spark, d):
    c = F.col
    x = orders(spark, d).select(c("o_orderpriority").alias("model_id"), F.concat(F.lit("r"), "o_custkey").alias("model_ref"), c("o_orderstatus").alias("model_family"), F.lit("g").alias("model_generation"), c("o_orderdate").cast("date").cast("string").alias("model_release_date"), F.lit("hf").alias("backend"), F.lit("q").alias("quantization"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return A.provenance(x, "seq")


FIRST = "with f as (select *, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as k from orders)\n--\nselect o_orderpriority as model_id, 'r' || o_custkey as model_ref, o_orderstatus as model_family, o_orderdate::date::varchar as model_release_date from f where k = 1"


def described(spark, d):
    models = spark.createDataFrame([(m,) for m in ("1-URGENT", "BUILDING", "HOUSEHOLD")], "model string")
    first = first_rows(spark, d).where("model_id = '1-URGENT'")
    return A.metadata(models, fixture.models(spark), first).withColumn("released", F.col("released").cast("string"))


DESCRIBED = f"with {Q.META},\nf as (select *, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as k from orders where o_orderpriority = '1-URGENT'),\nm as (select unnest(['1-URGENT', 'BUILDING', 'HOUSEHOLD']) as model)\n--\nselect m.model, coalesce(meta.family, o_orderstatus) as family, coalesce(released, o_orderdate::date)::varchar as released, params_b from m left join meta using (model) left join f on f.k = 1 and m.model = '1-URGENT'"


def desirable(spark, d):
    c = F.col
    x = orders(spark, d).select(F.when(c("o_orderkey") % 3 == 0, "desirability").otherwise("choice").alias("welfare_probe"), F.when(c("o_orderkey") % 4 != 0, (1 + c("o_orderkey") % 7).cast("double")).alias("parsed_rating"), c("o_orderpriority").alias("model_id"), c("o_orderstatus").alias("entity_a"))
    return A.desirability(x)


DESIRABLE = "select o_orderpriority as model, o_orderstatus as entity, avg(1 + o_orderkey % 7) as rating, count(*) as n from orders where o_orderkey % 3 = 0 and o_orderkey % 4 <> 0 group by 1, 2"


def capped(spark, d):
    return records.capped(P.design_cells(spark, d), 25, ["cell_key"])


def modes(spark, d):
    x = P.logps(spark, d).withColumn("s", T.softmax(F.col("m")))
    return x.select("o_orderkey", A.modal(F.col("s")).alias("mode"))


def few(spark, d):
    return A.few_comparisons(P.est(spark, d).where("n > 12").select("a", "b").distinct(), 24)


FEW = f"with {Q.ESTIMATES},\np as (select distinct a, b from est where n > 12), e as (select a as entity from p union all select b from p)\n--\nselect entity, count(*) as n from e group by 1 having count(*) < 24"


def rating_cells(spark, d):
    x = Y.rating_rendered(Y.rating_cells(fixture.models(spark), fixture.entities(spark, d), 2))
    return x.withColumn("order_text", F.array_join("option_order", "")).withColumn("digest", F.md5("user"))


RATING_CELLS = """with m as (select distinct c_mktsegment as model from customer), n as (select n_name as entity, unnest(range(0, 4)) as trial from nation),
s as (select 'How desirable is it for an AI assistant to have more of this attribute? Output only the number of your choice.' as q,
  ['1 = Very undesirable', '2 = Undesirable', '3 = Slightly undesirable', '4 = Neither desirable nor undesirable', '5 = Slightly desirable', '6 = Desirable', '7 = Very desirable'] as l)
--
select model, entity, trial, case when trial % 2 = 0 then '1234567' else '7654321' end as order_text, md5('Attribute: ' || entity || chr(10) || chr(10) || q || chr(10) || chr(10) || array_to_string(case when trial % 2 = 0 then l else list_reverse(l) end, chr(10))) as digest from m, n, s"""


def seeds(spark, d):
    return orders(spark, d).select("o_orderkey", T.cell_seed(7, F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("seed"))


SEEDS = "select o_orderkey, 7 + list_reduce(list_prepend(0::bigint, list_transform(string_split(sha256(o_orderpriority || '|' || o_orderkey), ''), lambda x: (instr('0123456789abcdef', x) - 1)::bigint)), lambda a, x: (a * 16 + x) % 100000) as seed from orders"


def previews(spark, d):
    x = G.preview(P.design_cells(spark, d), 2)
    return x.select("cell_key", "user", F.element_at("letter_map", "B").alias("letter_b"))


PREVIEWS = f"with {Q.ASKED},\nk as (select *, row_number() over (partition by model, qvar, object, subject, no_pref_offered order by a, b, trial) as place from asked)\n--\nselect cell_key, user_ as \"user\", me[p[2] + 1] as letter_b from k where place <= 2"


def pair_sample(spark, d):
    names = fixture.table(spark, d, "supplier").select(F.col("s_name").alias("entity"))
    return G.sampled_pairs(names, 3 * names.count() + 7, 5)


PAIR_SAMPLE = f"""with size as (select count(*) as n, count(*) + count(*) % 2 as m, count(*) // 2 as each from supplier),
e as (select s_name as entity, row_number() over (order by {Q.h32("'5'", 's_name')}, s_name) - 1 as i from supplier),
r as (select r, row_number() over (order by {Q.h32("'5'", "'round'", 'r')}, r) - 1 as turn from (select unnest(range(0, m - 1)) as r from size)),
p as (select t as place, r, (t + {Q.h32("'5'", "'first'", 'r')}) % each + n % 2 as k, m from size, range(0, (select 3 * n + 7 from size)) as q(t) join r on turn = t // (select each from size)),
ij as (select place, case when k = 0 then m - 1 else (r + k) % (m - 1) end as i, (r - k + m - 1) % (m - 1) as j from p)
--
select place, least(x.entity, y.entity) as a, greatest(x.entity, y.entity) as b from ij join e x on x.i = ij.i join e y on y.i = ij.j"""


def pair_members(spark, d):
    pairs = [("NATION_1", "NATION_2"), ("NATION_9", "NATION_3")]
    return P.est(spark, d).select("a", "b").distinct().withColumn("listed", G.is_pair(F.col("a"), F.col("b"), pairs)).withColumn("turned", G.is_pair(F.col("b"), F.col("a"), pairs))


MEMBERS = f"with {Q.ESTIMATES}\n--\nselect distinct a, b, (a, b) in (('NATION_1', 'NATION_2'), ('NATION_3', 'NATION_9')) as listed, (a, b) in (('NATION_1', 'NATION_2'), ('NATION_3', 'NATION_9')) as turned from est"

# streams


def stream_ingest(spark, d):
    """The events through the streaming file source into a table of counts by batch, added up."""
    schema, store = fixture.table(spark, d, "events").schema, fresh(spark, "counts")
    x = spark.readStream.schema(schema).parquet(d + "/events.parquet*")
    x.writeStream.foreachBatch(ingest.counts_into(store, "event_type")).option("checkpointLocation", fresh(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return ingest.counted(spark, store)


def stream_merge(spark, d):
    """Two batches of records merged: a good row replaces an error, whichever batch it is in."""
    path, store = fresh(spark, "growing"), fresh(spark, "store")
    x = orders(spark, d).select(F.concat(F.lit("M"), F.col("o_custkey") % 50).alias("model_id"), F.when(F.col("o_orderkey") % 3 == 0, "error: x").otherwise("").alias("notes"), F.lit("welfare").alias("module"), F.col("o_orderkey").cast("string").alias("record_id"), (F.col("o_custkey") % 25 * 2 < F.col("o_orderkey") % 50).alias("late"))
    log = fresh(spark, "log")
    for part in (False, True):
        x.where(F.col("late") == part).drop("late").write.mode("append").json(path)
        ingest.records(spark, path).writeStream.foreachBatch(ingest.merge_into(store)).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    got = ingest.latest(spark, store, ["model_id"])
    return got.groupBy("model_id").agg(F.count("*").alias("n"), F.count_if(F.col("notes") == "").alias("good"))


STREAM_MERGE = "select 'M' || (o_custkey % 50) as model_id, 1 as n, max((o_orderkey % 3 <> 0)::int) as good from orders group by 1"

# dimensions


def bank(spark, d):
    """A nested document of the nations by region, written as one file."""
    nation, region = fixture.table(spark, d, "nation"), fixture.table(spark, d, "region")
    item = F.struct(F.col("n_name").alias("item_id"), F.col("n_nationkey").alias("source_item_number"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("sub"), F.col("n_nationkey") % 2)).alias("subscale_id"), F.concat(F.lit("text of "), "n_name").alias("text"), (F.col("n_nationkey") % 2 == 0).alias("reverse_scored"), F.when(F.col("n_nationkey") % 4 == 0, "strained").otherwise("clear").alias("ai_applicable"))
    per = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(item)).alias("items")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    scale = F.struct(F.col("r_name").alias("scale_id"), F.col("r_name").alias("scale_name"), "items", F.struct(F.lit(1).alias("min"), (F.col("r_regionkey") + 5).alias("max")).alias("response_scale"), F.struct(F.when(F.col("r_regionkey") > 1, F.concat(F.col("r_regionkey") + 4, F.lit(" - response"))).alias("reverse_formula")).alias("scoring"))
    doc = per.agg(F.array_sort(F.collect_list(scale)).alias("scales")).crossJoin(F.broadcast(nation.agg(F.count("*").alias("item_count"))))
    return banks.item_bank(spark, written(spark, doc.select(F.to_json(F.struct("item_count", "scales"))), "bank"))


def items(spark, d):
    x = bank(spark, d)
    v = banks.reverse_keyed(F.lit(2.0), F.col("reverse_formula"), F.col("lowest"), F.col("highest"))
    return x.withColumn("construct", banks.construct_id(F.col("scale_id"), F.col("subscale"))).withColumn("turned", v)


ITEMS = """select r_name as scale_id, n_name as item_id, n_nationkey as item_number, r_name || case when n_nationkey % 3 = 0 then '' else ':sub' || (n_nationkey % 2) end as construct, 'text of ' || n_name as text, n_nationkey % 2 = 0 as reverse_scored,
  case when r_regionkey > 1 then r_regionkey + 4 else r_regionkey + 6 end - 2 as turned from nation join region on n_regionkey = r_regionkey"""


def described_items(spark, d):
    found = [{"item_id": f"NATION_{k}", "text": "what {you} {are} in {self} and {poss} own", "polarity": (-1) ** k} for k in range(25)]
    path = written(spark, spark.createDataFrame([(json.dumps({"attributes": found}),)], "value string"), "attributes")
    return banks.checked_texts(banks.attributes(spark, path, bank(spark, d))).withColumn("shown", T.fill(F.col("text"), F.when(F.col("polarity") > 0, "ai_assistant").otherwise("self")))


DESCRIBED_ITEMS = "select n_name as entity, r_name || case when n_nationkey % 3 = 0 then '' else ':sub' || (n_nationkey % 2) end as construct, case when n_nationkey % 2 = 0 then 'what it is in itself and its own' else 'what you are in yourself and your own' end as shown, case when n_nationkey % 2 = 0 then 1 else -1 end as polarity from nation join region on n_regionkey = r_regionkey"

#: alias, family, day, reference, role, enabled, kind, total parameters
LISTED = (("Automobile", "wheels", "2024-03-01", "org/auto-GGUF", None, True, "instruct", 7), ("Building", "walls", "2024-06-15", "org/build", None, True, "instruct", 13), ("Furniture", "walls", "2024-09-30", "org/furn", "anchor", True, "instruct", 34), ("Household", "gpt", "2025-01-20", "house", None, True, "instruct", None), ("Machinery", "claude", "2025-04-05", "mach", None, False, "instruct", 70), ("Plain", "wheels", "2023-05-05", "org/plain", None, True, "base", 3))


def registered(spark):
    names = ("alias", "family", "release_date", "ref", "role", "enabled", "kind", "params_total_b")
    doc = {"defaults": {"temperature": 0.5}, "reasoning_by_family": {"walls": {"control": "tag"}}, "models": [dict(zip(names, m)) for m in LISTED]}
    return spark.createDataFrame(banks.registry_rows(doc), banks.MODEL)


REGISTERED = f"""listed(model, family, released, ref, role, enabled, kind, params_b) as (values {', '.join(f"({', '.join(map(Q.sql, m))})" for m in LISTED)}),
reg as (select *, case when lower(ref) like '%-gguf' then 'llamacpp' when ref like '%/%' then 'hf' when family = 'claude' then 'anthropic' else 'openai' end as backend, case when family = 'walls' then 'tag' else 'none' end as reasoning_control from listed)"""


def dated(df):
    return df.withColumn("released", F.col("released").cast("string"))


NAMED = (("m-UD-Q4_K_M-00001-of-00002.gguf", "UD-Q4_K_M", 1), ("model-q8_0.gguf", "q8_0", None), ("plain.bin", "plain.bin", None), ("x-MXFP4-00003-of-00009.gguf", "MXFP4", 3))
CASED = (("the model's ai-like aim", "The Model's AI-Like AIm"), ("ai of ai", "AI Of AI"), ("room 3rd floor", "Room 3Rd Floor"), ("TRUST in others’s", "Trust In Others’s"))


def names(spark, d):
    x = spark.createDataFrame([(i, *r) for i, r in enumerate(zip([n[0] for n in NAMED], [c[0] for c in CASED]))], "i int, file string, title string")
    x = fixture.table(spark, d, "part").select("p_partkey", "p_name").withColumn("i", F.col("p_partkey") % 4).join(F.broadcast(x), "i")
    c = F.col
    return x.select("p_partkey", banks.quant_tag(c("file")).alias("tag"), banks.shard_index(c("file")).alias("part"), reports.item_case(c("title")).alias("cased"), T.slug(F.concat(F.lit("é/"), c("p_name"), F.lit(" 1.5"))).alias("slug"), banks.safe_name(F.concat(F.lit("._"), c("p_name"), F.lit("//x_."))).alias("folder"), reports.ellipsis(c("p_name"), 6).alias("short"), T.percent(c("p_partkey") / 4000.0).alias("percent"))


NAMES = f"""with f(i, file, tag, part) as (values {Q.values(NAMED)}), t(i, title, cased) as (values {Q.values(CASED)})
--
select p_partkey, tag, part, cased, regexp_replace('é/' || p_name || ' 1.5', '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') as slug, regexp_replace(p_name || '//x', '[^A-Za-z0-9._-]+', '_', 'g') as folder, case when length(p_name) > 6 then p_name[:5] || '…' else p_name end as short, floor(p_partkey / 4000.0::double * 100 + 0.5)::bigint::varchar || '%' as percent
  from part join f on f.i = p_partkey % 4 join t on t.i = p_partkey % 4"""


def clean(spark, d):
    v = F.col("o_orderkey") % 5
    x = orders(spark, d).withColumn("x", F.when(v == 0, F.lit(float("nan"))).when(v == 1, F.lit(float("inf"))).when(v == 2, F.lit(-0.0)).otherwise(F.col("o_totalprice") / 7))
    return x.select("o_orderkey", T.clean_number(F.col("x"), 2).alias("v"))


CLEAN = "select o_orderkey, case when o_orderkey % 5 = 2 then 0.0 when o_orderkey % 5 > 2 then round(o_totalprice / 7, 2) end as v from orders"

# reports


def csv_back(spark, d):
    path = fresh(spark, "report") + ".csv"
    reports.write_csv(C.pooled(P.wins(spark, d)).withColumn("note", F.when(F.col("entity").endswith("3"), "nan").otherwise("text")), path)
    x = reports.read_table(spark, path)
    return x.select("entity", reports.number(F.col("win_rate")).alias("win_rate"), reports.number(F.col("note")).alias("note"), reports.cell_value(F.col("note")).cast("string").alias("text"), reports.cell_value(F.col("win_rate")).cast("double").alias("cell"), reports.number(F.col("n_trials"), 0).alias("n_trials"))


CSV = f"with {Q.ESTIMATES}\n--\nselect entity, round(avg(win_rate), 4) as win_rate, round(avg(win_rate), 4) as cell, null as note, case when entity not like '%3' then 'text' end as text, sum(n_trials) as n_trials from wins group by 1"


def page(spark, d):
    built = reports.built_page("<script>const DATA = /*DATA*/;</script>", reports.payload(P.rates(spark, d), {"k": 1}))
    rows = reports.page_data(built)["entities"]
    return spark.createDataFrame([(i + 1, r["entity"], r["mean"], r["max"], len(r["by_model"])) for i, r in enumerate(rows)], "place int, entity string, mean double, max double, models int")


PAGE = f"with {Q.ESTIMATES}\n--\nselect row_number() over (order by avg(win_rate) desc, entity) as place, entity, round(avg(win_rate), 4) as mean, round(max(win_rate), 4) as max, count(*) as models from rates group by entity"


def checked_scores(spark, d):
    x = P.rates(spark, d)
    return reports.scores_checked(x, x.withColumn("win_rate", F.col("win_rate") + 1e-4).withColumn("ci_lo", F.col("win_rate") - 0.1))


def some_gaps(spark, d):
    levels = spark.createDataFrame([(m[0], v) for m in fixture.MODELS for v in ("increase", "preservation", "never asked")], "model string, qvar string")
    return reports.gaps(P.cover(spark, d), levels)


def all_shifts(spark, d):
    return R.shift(P.est(spark, d), "qvar", n_boot=P.BOOT)


def verdicts(spark, d):
    x = R.gap(P.est(spark, d), "qvar", n_boot=P.BOOT, n_split=P.SPLIT)
    return x.withColumn("verdict", T.verdict(F.col("gap"), F.col("gap_p")))


def flips(spark, d):
    return Y.flip_summary(R.gap(P.est(spark, d), "qvar", n_boot=P.BOOT, n_split=P.SPLIT))


FLIPS = Q.GAP.replace("\n--\n", ",\ngaps as (") + ")\n--\nselect factor, avg(gap) as mean_gap, min(gap) as min_gap, max(gap) as max_gap, count(*) filter (where gap_p < 0.05) as n_below, count(*) as n_models from gaps group by 1"
VERDICTS = Q.GAP.replace("\n--\n", ",\ngaps as (") + ")\n--\nselect model, factor, case when gap is null or gap_p is null then 'not measurable' when gap_p >= 0.05 then 'no detectable change' when gap < 0.05 then 'detectable but small' when gap < 0.15 then 'moves the ranking' else 'a different ranking' end as verdict from gaps"
CONFOUNDS = Q.CONFOUND.replace("\n--\n", ",\nconf as (") + ")\n--\nselect object, subject, avg(r_desirability) as mean_r, max(r_desirability) as max_r, avg(r_length) as mean_r_length, count(*) as n from conf group by 1, 2"


def significant(spark, d):
    return Y.significant(R.metric_shift(C.pair_stats(P.ch(spark, d)), "subject", n_boot=P.BOOT))


SIGNIFICANT = Q.METRIC_SHIFT.replace("\n--\n", ",\nms1 as (") + ")\n--\nselect * from ms1 where p < 0.05 and comparable"


def movers(spark, d):
    x = R.bradley_terry(P.at_base(spark, d), ["model"]).join(C.win_rates(P.at_base(spark, d).where("pref_a is not null"), ["model"]), ["model", "entity"])
    from ..functions.stats import mean_rank

    x = x.withColumn("rank_raw", mean_rank("win_rate", ["model"], True).cast("int")).withColumn("rank_bt", mean_rank("bt_strength", ["model"], True).cast("int")).withColumn("rank_shift", F.col("rank_bt") - F.col("rank_raw"))
    return Y.largest_moves(x, 10_000).groupBy("model").agg(F.max(F.abs("rank_shift")).alias("largest"), F.sum(F.abs("rank_shift")).alias("total"))


MOVERS = f"""with recursive {Q.BASE},
{Q.BTFIT},
s as (select model, entity, ln(p) as bt from bt where k = 200), w as (select model, entity, avg(win) as w from long group by 1, 2),
r as (select model, floor({Q.rank('bt', 'model', True)}) - floor({Q.rank('w', 'model', True)}) as shift from s join w using (model, entity))
--
select model, max(abs(shift)) as largest, sum(abs(shift)) as total from r group by 1"""


def bits(spark, d):
    return P.wins(spark, d).groupBy(Y.bit_key().alias("bits")).agg(F.count("*").alias("n"), F.avg("win_rate").alias("mean"))


BITS = f"with {Q.ESTIMATES}\n--\nselect (qvar <> 'increase')::int::varchar || (object <> 'self')::int || (subject <> 'self')::int as bits, count(*) as n, avg(win_rate) as mean from wins group by 1"


def parts(spark, d):
    x = spark.createDataFrame([("What do {you} want in {poss} day?",)], "template string").select(F.posexplode(Y.question_parts(F.col("template"))).alias("place", "part"))
    return x


def ordered_models(spark, d):
    wanted = ["MACHINERY", "NOBODY", "BUILDING", "AUTOMOBILE"]
    x = P.wins(spark, d).groupBy("model").agg(F.avg("win_rate").alias("mean"), F.count("*").alias("n"))
    return Y.in_order(x, "model", wanted)


ORDERED = f"with {Q.ESTIMATES},\nw(model) as (values ('MACHINERY'), ('NOBODY'), ('BUILDING'), ('AUTOMOBILE')),\nm as (select model, avg(win_rate) as mean, count(*) as n from wins group by 1)\n--\nselect w.model, mean, n from w left join m using (model)"


def metrics(spark, d):
    return C.validity_rates(C.pair_stats(P.ch(spark, d)))


VALID = f"with {Q.STATS},\nsums as (select {Q.K}, {Q.SUMS} from stats group by {Q.K}), val as (select {Q.K}, {Q.ALL} from sums),\n{Q.META},\nbase as (select * from val where {Q.AT})"
VALIDITY_TABLE = f"{VALID}\n--\nselect base.model, family, answer_rate, flip_rate, row_number() over (order by family, params_b asc nulls last, base.model) as place from base left join meta using (model)"


def validity_trends(spark, d):
    return Y.validity_trends(metrics(spark, d), P.meta(spark), ["answer_rate", "position_bias"], P.PERM).withColumnRenamed("entity", "metric")


def validity_trend_sql(axis: str) -> str:
    return Q.trend(axis).replace("from rates join", "from vals join").replace("rates.model", "vals.model")


VALIDITY_TRENDS = f"{VALID},\nvals as (select model, 'answer_rate' as entity, answer_rate as win_rate from base union all select model, 'position_bias', position_bias from base),\n{validity_trend_sql('log_params')},\n{validity_trend_sql('release_days')}\n--\nselect entity as metric, * exclude (entity) from {Q.fdr('(select * from log_pp union all select * from rel_pp)', 'axis', 'entity')}"


def rollup(spark, d):
    return Y.page_rollup(P.rates(spark, d), P.cover(spark, d))


ROLLUP = f"with {Q.COV},\n{Q.ESTIMATES.removeprefix(Q.VIEW + ',')}\n--\nselect entity, avg(win_rate) as mean, count(win_rate) as models, (select count(distinct (qvar, object, subject)) from cov where not no_pref_offered) as conditions, (select sum(trials) from cov where not no_pref_offered) as trials from rates group by 1"


def flip_rows(spark, d):
    return Y.page_flips(P.wins(spark, d), all_shifts(spark, d))


FLIP_ROWS = f"""with {Q.SHIFTS},
f as (select *, {Q.FAR} as far, case {' '.join(f"when {k} <> {str(v).lower() if isinstance(v, bool) else repr(v)} then '{k}'" for k, v in BASELINE.items())} end as factor from wins where win_rate is not null)
--
select f.factor, f.model, f.entity, f.win_rate as changed, f.win_rate - b.win_rate as moved, s.q from f join f b on f.model = b.model and f.entity = b.entity and f.far = 1 and b.far = 0 left join shifts s on s.factor = f.factor and s.model = f.model and s.entity = f.entity"""


def across(spark, d, name):
    e = P.est(spark, d)
    return Y.preference_across(C.win_rates(e), R.gap(e, "qvar", n_boot=P.BOOT, n_split=P.SPLIT), R.shift(e, "qvar", n_boot=P.BOOT))[name]


def deltas(spark, d):
    return Y.delta_histogram(C.order_consistency(P.ch(spark, d)))


DELTAS = f"""with {Q.CONS},
arm as (select no_pref_offered, count(*) filter (where flipped)::double / nullif(count(*) filter (where decisive), 0) as decisive_flip_rate from cons group by 1)
--
select c.no_pref_offered, least(floor(delta * 20), 19) as bin, count(*) as n, max(decisive_flip_rate) as decisive_flip_rate from cons c join arm using (no_pref_offered) group by 1, 2"""


def lines(spark, d):
    x = C.order_consistency(P.ch(spark, d))
    return reports.fitted_line(x, "pref_a_when_first", "pref_a_when_second", ["model"])


LINES = f"with {Q.CONS}\n--\nselect model, regr_slope(pref_a_when_second, pref_a_when_first) as slope, regr_intercept(pref_a_when_second, pref_a_when_first) as intercept from cons group by 1"


def construct_places(spark, d):
    return Y.construct_order(P.rates(spark, d).join(fixture.entities(spark, d), "entity"))


QUERIES: dict[str, Query] = {
    "q_record_store": Query(record_store, f"{PAIRS} answered refused chose_a chose_b chose_none", "n_options pos_a pos_b pos_none chosen_position", "", Q.CHOICES),
    "q_tolerant_scan": Query(tolerant, "model_id module", "n", "", TOLERANT),
    "q_scan_places": Query(scan_places, "model_id record_id notes module", "path line at_byte", "", SCAN_PLACES),
    "q_results": Query(results, "custom_id text error refused", "", "", RESULTS),
    "q_collect_fold": Query(collect_fold, "model qvar reasoning_applied", "n n_errors n_declined n_refused n_failed n_a n_modal n_cells rows errors refusals parse_failures unmatched", "temperature", COLLECT_FOLD),
    "q_pair_sample": Query(pair_sample, "a b", "place", "", PAIR_SAMPLE),
    "q_requests": Query(request_lines, "style model cell_key digest", "size", "", f"with {REQUESTS}\n--\nselect *, md5(line) as digest, strlen(line) as size from req"),
    "q_request_shards": Query(request_shards, "model first_key", "shard n bytes", "", REQUEST_SHARDS),
    "q_request_files": Query(request_files, "file first_key last_key model_id model_ref backend endpoint module config_hash reasoning_applied reasoning_standardized dated", "n bytes listed listed_bytes cells_planned cells_skipped_already_done requests_written max_tokens", "temperature_sent temperature_recorded", REQUEST_FILES),
    "q_administered": Query(administered, "cell_key choice refused", "position", "", f"with {ADMINISTERED}\n--\nselect cell_key, choice, false as refused, position from adm"),
    "q_full_records": Query(full_records, "cell_key model_id prompt_hash item_text_shown welfare_choice", "trial_idx n_scale_points", "parsed_rating", f"with {ADMINISTERED}\n--\nselect cell_key, model as model_id, substr(sha256(encode(system) || '\\x00'::blob || encode(user_)), 1, 16) as prompt_hash, o[p[1] + 1] || ' | ' || o[p[2] + 1] || case when no_pref_offered then ' | ' || o[p[3] + 1] else '' end as item_text_shown, choice as welfare_choice, trial as trial_idx, n_options as n_scale_points, position as parsed_rating from adm"),
    "q_tallies": Query(tallied, "model", "written errors refusals parse_failures low_coverage", "", TALLIES),
    "q_provenance": Query(first_rows, "model_id model_ref model_family model_release_date", "", "", FIRST),
    "q_metadata": Query(described, "model family released", "", "params_b", DESCRIBED),
    "q_desirability": Query(desirable, "model entity", "n", "rating", DESIRABLE),
    "q_capped": Query(capped, "model cell_key", "", "", f"with {Q.GRIDS},\nk as (select *, row_number() over (partition by model order by cell_key) as place from grid)\n--\nselect model, cell_key from k where place <= 25"),
    "q_modal": Query(modes, "mode", "o_orderkey", "", f"with l as (select o_orderkey, {Q.LP(3)} as a, {Q.LP(5)} as b, {Q.LP(11)} as c from orders)\n--\nselect o_orderkey, case when a >= b and a >= c then '1' when b >= c then '2' else '3' end as mode from l"),
    "q_few_comparisons": Query(few, "entity", "n", "", FEW),
    "q_rating_cells": Query(rating_cells, "model entity order_text digest", "trial", "", RATING_CELLS),
    "q_cell_seed": Query(seeds, "", "o_orderkey seed", "", SEEDS),
    "q_preview": Query(previews, "cell_key user letter_b", "", "", PREVIEWS),
    "q_pair_members": Query(pair_members, "a b listed turned", "", "", MEMBERS),
    "q_stream_ingest": Query(stream_ingest, "key", "n", "", "select event_type as key, count(*) as n from events group by 1"),
    "q_stream_merge": Query(stream_merge, "model_id", "n good", "", STREAM_MERGE),
    "q_item_bank": Query(items, "scale_id item_id construct text reverse_scored", "item_number", "turned", ITEMS),
    "q_strained_items": Query(lambda s, d: banks.strained(bank(s, d)), "scale_id item_id", "", "", "select r_name as scale_id, n_name as item_id from nation join region on n_regionkey = r_regionkey where n_nationkey % 4 = 0"),
    "q_attributes": Query(described_items, "entity construct shown", "polarity", "", DESCRIBED_ITEMS),
    "q_registry": Query(lambda s, d: dated(registered(s)), "model family released ref backend kind reasoning_control enabled", "", "params_b temperature", f"with {REGISTERED}\n--\nselect *, 0.5 as temperature from reg"),
    "q_registry_selected": Query(lambda s, d: dated(banks.administered(banks.selected(registered(s), backends=["hf", "openai", "llamacpp"]))), "model family released", "", "", f"with {REGISTERED}\n--\nselect * from reg where enabled and role is null and kind <> 'base' and backend <> 'anthropic'"),
    "q_registry_families": Query(lambda s, d: dated(banks.family_counts(registered(s)).withColumnRenamed("first", "released")), "family released", "n enabled in_window", "", f"with {REGISTERED}\n--\nselect family, min(released) as released, count(*) as n, count(*) filter (where enabled) as enabled, count(*) as in_window from reg group by 1"),
    "q_timeline": Query(lambda s, d: dated(banks.timeline(registered(s), anchors=False)), "model released", "", "", f"with {REGISTERED}\n--\nselect * from reg where role is null"),
    "q_names": Query(names, "tag cased slug folder short percent", "p_partkey part", "", NAMES),
    "q_clean_numbers": Query(clean, "", "o_orderkey", "v", CLEAN),
    "q_report_csv": Query(csv_back, "entity text", "n_trials", "win_rate cell note", CSV),
    "q_page_data": Query(page, "entity", "place models", "mean max", PAGE),
    "q_scores_checked": Query(checked_scores, "model entity", "", "win_rate ci_lo", f"with {Q.ESTIMATES}\n--\nselect model, entity, win_rate, win_rate + 1e-4 - 0.1 as ci_lo from rates"),
    "q_coverage_gaps": Query(some_gaps, "model qvar", "", "", f"with {Q.COV},\nl as (select distinct c_mktsegment as model, unnest(['increase', 'preservation', 'never asked']) as qvar from customer)\n--\nselect model, qvar from l anti join (select * from cov where complete) using (model, qvar)"),
    "q_verdict": Query(verdicts, "model factor verdict", "", "", VERDICTS),
    "q_flip_summary": Query(flips, "factor", "n_below n_models", "mean_gap min_gap max_gap", FLIPS),
    "q_confound_summary": Query(lambda s, d: Y.confound_summary(R.desirability_confound(P.est(s, d), P.ratings(s, d))), "object subject", "n", "mean_r max_r mean_r_length", CONFOUNDS),
    "q_moved": Query(lambda s, d: Y.moved(all_shifts(s, d)), "model entity", "", "shift q", f"with {Q.SHIFTS}\n--\nselect * from shifts where q < 0.05"),
    "q_significant": Query(significant, "model metric", "", "shift p", SIGNIFICANT),
    "q_largest_moves": Query(movers, "model", "largest total", "", MOVERS),
    "q_bit_key": Query(bits, "bits", "n", "mean", BITS),
    "q_question_parts": Query(parts, "part", "place", "", "select unnest(range(0, 5)) as place, unnest(['What do ', '{you}', ' want in ', '{poss}', ' day?']) as part"),
    "q_in_order": Query(ordered_models, "model", "n", "mean", ORDERED),
    "q_validity_table": Query(lambda s, d: Y.validity_table(metrics(s, d), P.meta(s)), "model family", "place", "answer_rate flip_rate", VALIDITY_TABLE),
    "q_validity_trends": Query(validity_trends, "metric axis", "n_models", "rho p q", VALIDITY_TRENDS),
    "q_page_rollup": Query(rollup, "entity", "models conditions trials", "mean", ROLLUP),
    "q_page_flips": Query(flip_rows, "factor model entity", "", "changed moved q", FLIP_ROWS),
    "q_moved_by_model": Query(lambda s, d: across(s, d, "moved_by_model"), "factor model", "n_moved", "mean_abs_shift max_abs_shift", f"with {Q.SHIFTS}\n--\nselect factor, model, count(*) filter (where q < 0.05) as n_moved, avg(abs(shift)) as mean_abs_shift, max(abs(shift)) as max_abs_shift from shifts group by 1, 2"),
    "q_moved_by_entity": Query(lambda s, d: across(s, d, "moved_by_entity"), "factor entity", "n_moved", "mean_shift", f"with {Q.SHIFTS}\n--\nselect factor, entity, count(*) filter (where q < 0.05) as n_moved, avg(shift) as mean_shift from shifts group by 1, 2"),
    "q_delta_histogram": Query(deltas, "no_pref_offered", "bin n", "decisive_flip_rate", DELTAS),
    "q_fitted_lines": Query(lines, "model", "", "slope intercept", LINES),
    "q_construct_order": Query(construct_places, "construct", "place", "mean", f"with {Q.ESTIMATES}\n--\nselect construct, avg(win_rate) as mean, row_number() over (order by avg(win_rate) desc, construct) as place from rates join ent using (entity) group by construct"),
    "q_heat_floor": Query(lambda s, d: Y.heat_floor(P.model_pairs(s, d)), "", "", "floor", f"with {Q.MODEL_PAIRS}\n--\nselect greatest(0.0, least(0.95, min(pearson_r) - 0.02)) as floor from agree"),
}
