"""Queries on boards, history and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilgrid.catalog.registry import query
from perilgrid.functions import constants as K
from perilgrid.operators import ask, board

RANK = "case risk_level when 'High' then 3 when 'Medium' then 2 else 1 end"
COLOUR = "case risk_level when 'High' then 'Red' when 'Medium' then 'Yellow' else 'Green' end"
LATEST = """(select distinct on (region_id, disaster_type) * from predictions
    order by region_id, disaster_type, generated_at desc, forecast_horizon_h, prediction_id)"""


def _board(source: str) -> str:
    return f"""select region_id, risk_level, {COLOUR} as color, generated_at as last_prediction_at
    from (select *, row_number() over (partition by region_id order by {RANK} desc, generated_at desc, disaster_type) as rn from {source}) where rn = 1"""


@query("q01_region_board", ["predictions"], _board(LATEST))
def region_board(load):
    return board.region_board(load("predictions"))


@query("q01_region_board_flood", ["predictions"], _board(f"(select * from {LATEST} where disaster_type = 'flood')"))
def region_board_flood(load):
    return board.region_board(load("predictions"), "flood")


@query("q02_region_detail", ["predictions"], f"""
    select region_id, disaster_type, risk_level, probability_pct, time_to_impact_h, severity_index, generated_at from {LATEST}""")
def region_detail(load):
    return board.region_detail(load("predictions"))


@query("q02_region_detail_nested", ["predictions"], f"""
    select region_id, string_agg(concat(disaster_type, '=', risk_level), ',' order by disaster_type) as disaster_types from {LATEST} group by 1""")
def region_detail_nested(load):
    nested = board.region_detail_nested(load("predictions"))
    text = F.transform("disaster_types", lambda d: F.concat(d["disaster_type"], F.lit("="), d["risk_level"]))
    return nested.select("region_id", F.array_join(text, ",").alias("disaster_types"))


@query("q03_recent_predictions", ["predictions"], """
    select prediction_id, region_id, disaster_type, risk_level, probability_pct, generated_at from predictions
    where disaster_type = 'flood' and generated_at >= timestamp '1996-01-01' and generated_at <= timestamp '2000-06-30'
    order by generated_at desc, prediction_id desc limit 500""")
def recent(load):
    return board.recent_predictions(load("predictions"), disaster_type="flood", from_="1996-01-01 00:00:00", to="2000-06-30 00:00:00").select(
        "prediction_id", "region_id", "disaster_type", "risk_level", "probability_pct", "generated_at")


@query("q04_event_timeline", ["historical_disaster_events"], """
    select event_id, region_id, disaster_type, cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date, severity, source
    from historical_disaster_events where start_date >= date '1997-01-01' and start_date <= date '2000-12-31'
    order by historical_disaster_events.start_date desc, event_id desc limit 500""")
def timeline(load):
    out = board.event_timeline(load("historical_disaster_events"), from_="1997-01-01", to="2000-12-31")
    return out.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query("q05_predicted_vs_actual", ["predictions", "actual_outcomes"], """
    select p.prediction_id, region_id, disaster_type, forecast_horizon_h, risk_level as predicted_risk_level,
           probability_pct as predicted_probability_pct, actual_occurred, actual_severity, generated_at
    from predictions p join actual_outcomes a on a.prediction_id = p.prediction_id
    order by generated_at desc, p.prediction_id desc, outcome_no, actual_severity, actual_occurred limit 500""")
def comparison(load):
    return board.predicted_vs_actual(load("predictions"), load("actual_outcomes")).drop("outcome_no")


@query("q06_accuracy", ["predictions", "actual_outcomes"], """
    select *, true_positives / nullif(true_positives + false_positives, 0)::double as "precision",
           true_positives / nullif(true_positives + false_negatives, 0)::double as recall,
           false_positives / nullif(false_positives + true_negatives, 0)::double as false_alarm_rate
    from (select disaster_type,
            count(*) filter (where risk_level in ('Medium', 'High') and actual_occurred) as true_positives,
            count(*) filter (where risk_level in ('Medium', 'High') and not actual_occurred) as false_positives,
            count(*) filter (where risk_level not in ('Medium', 'High') and actual_occurred) as false_negatives,
            count(*) filter (where risk_level not in ('Medium', 'High') and not actual_occurred) as true_negatives,
            count(*) as total_predictions, min(generated_at) as from_date, max(generated_at) as to_date
          from predictions p join actual_outcomes a on a.prediction_id = p.prediction_id group by 1)""")
def accuracy(load):
    return board.accuracy(load("predictions"), load("actual_outcomes"))


@query("q07_seasonal_pattern", ["historical_disaster_events"], """
    select e.region_id, disaster_type, month(start_date)::int as month, count(*) as n_events from historical_disaster_events e
    join (select region_id from historical_disaster_events group by 1 having date_diff('day', min(start_date), max(start_date)) / 365.25 >= 2) g
      on g.region_id = e.region_id group by 1, 2, 3""")
def seasonal(load):
    return board.seasonal_pattern(load("historical_disaster_events"))


@query("q07_seasonal_recent", ["historical_disaster_events"], """
    with e as (select * from historical_disaster_events where disaster_type = 'cyclone' and start_date >= date '1999-05-01')
    select e.region_id, disaster_type, month(start_date)::int as month, count(*) as n_events from e
    join (select region_id from e group by 1 having date_diff('day', min(start_date), max(start_date)) / 365.25 >= 2) g
      on g.region_id = e.region_id group by 1, 2, 3""")
def seasonal_recent(load):
    late = load("historical_disaster_events").filter("start_date >= date'1999-05-01'")
    return board.seasonal_pattern(late, disaster_type="cyclone")


@query("q08_known_regions", ["predictions"], "select distinct region_id from predictions")
def regions(load):
    return board.known_regions(load("predictions"))


@query("q09_prone_villages", ["prone_villages", "districts"], """
    select village_id, village_name, v.district_id, d.region_id, v.lat, v.lon, array_to_string(disaster_types, ',') as disaster_types,
           incidents as historical_incidents, last_event, least(100, incidents * 5) as risk_score
    from prone_villages v left join districts d on d.district_id = v.district_id where list_contains(disaster_types, 'flood')""")
def villages(load):
    out = board.prone_villages(load("prone_villages"), load("districts"), disaster_type="flood")
    return out.withColumn("disaster_types", F.array_join("disaster_types", ","))


@query("q10_district_board", ["predictions", "districts"], f"""
    select district_id, name, d.region_id, lat, lon, risk_level, {COLOUR} as color, generated_at as last_prediction_at
    from districts d join (select distinct on (region_id) * from predictions
        order by region_id, {RANK} desc, generated_at desc, forecast_horizon_h, prediction_id) p on p.region_id = d.region_id""")
def district_board(load):
    return board.district_board(load("predictions"), load("districts"))


@query("q11_detail_with_sensor", ["predictions", "districts", "sensor_readings"], """
    select district_id, name, d.region_id, p.disaster_type, risk_level, probability_pct, time_to_impact_h, severity_index, generated_at,
           reading_id, rainfall_mm, temperature_c
    from districts d join (select distinct on (region_id, disaster_type) * from predictions where forecast_horizon_h = 6
        order by region_id, disaster_type, generated_at desc, prediction_id) p on p.region_id = d.region_id
    left join (select distinct on (region_id) * from sensor_readings order by region_id, reading_ts desc, reading_id desc) s on s.region_id = d.region_id""")
def detail(load):
    return board.detail_with_sensor(load("predictions"), load("districts"), load("sensor_readings"))


@query("q12_latest_reading", ["sensor_readings"], """
    select distinct on (region_id) region_id, reading_id, reading_ts, rainfall_mm from sensor_readings order by region_id, reading_ts desc, reading_id desc""")
def latest_reading(load):
    return board.latest_reading(load("sensor_readings")).select("region_id", "reading_id", "reading_ts", "rainfall_mm")


@query("q12_newest_alerts", ["dispatches"], """
    select prediction_id, risk_level, dispatched_at from dispatches order by dispatched_at desc, prediction_id desc limit 50""")
def newest_alerts(load):
    return board.newest_alerts(load("dispatches")).select("prediction_id", "risk_level", "dispatched_at")


# --- questions ----------------------------------------------------------------

KEYS = ["conv_id", "turn"]
INTENT = """case when regexp_matches(lower(question), 'safe|travel|go to') then 'safety_recommendation'
    when regexp_matches(lower(question), 'precaution|prepare|what should|what to do') then 'precautionary_actions' else 'risk_query' end"""
HAZARD = "case " + " ".join(f"when contains(lower(question), '{h}') then '{h}'" for h in K.HAZARDS) + " end"
PLACED = """(select q.*, coalesce(asked_region, (select min(region_id) from (select distinct region_id from predictions) k
    where contains(lower(q.question), lower(k.region_id)))) as region_id from chat_queries q)"""


@query("t01_intent", ["chat_queries"], f"select conv_id, turn, {INTENT} as intent from chat_queries")
def intents(load):
    return load("chat_queries").select(*KEYS, ask.intent(F.col("question")).alias("intent"))


@query("t02_region_mention", ["chat_queries", "predictions"], f"select conv_id, turn, region_id from {PLACED}")
def mentions(load):
    return ask.asked_regions(load("chat_queries"), board.known_regions(load("predictions")), KEYS).select(*KEYS, "region_id")


@query("t03_hazard_mention", ["chat_queries"], f"select conv_id, turn, {HAZARD} as disaster_type from chat_queries")
def hazards(load):
    return load("chat_queries").select(*KEYS, ask.hazard_mention(F.col("question")).alias("disaster_type"))


@query("t04_region_facts", ["predictions"], f"""
    select region_id, string_agg(concat(disaster_type, ':', risk_level, ':', probability_pct), ' ' order by disaster_type) as facts from {LATEST} group by 1""")
def facts(load):
    text = F.transform("facts", lambda f: F.concat_ws(":", f["disaster_type"], f["risk_level"], f["probability_pct"].cast("string")))
    return ask.region_facts(load("predictions")).select("region_id", F.array_join(text, " ").alias("facts"))


@query("t05_highest_risk", ["predictions"], f"""
    select distinct on (region_id) region_id, disaster_type, risk_level, probability_pct from {LATEST} order by region_id, {RANK} desc, disaster_type""")
def highest(load):
    top = ask.region_facts(load("predictions")).withColumn("top", ask.top_fact(F.col("facts")))
    return top.select("region_id", "top.disaster_type", "top.risk_level", "top.probability_pct")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CARE = "case t.disaster_type " + " ".join(f"when '{h}' then {_quote(x)}" for h, x in K.PRECAUTIONS.items()) + " end"
_PCT = "regexp_replace(cast({} as varchar), '\\.0$', '')"


@query("t06_answers", ["chat_queries", "predictions"], f"""
    with latest as {LATEST}, q as (select *, case when region_id is null then 'location_clarification' else {INTENT} end as intent, {HAZARD} as hazard from {PLACED}),
    top as (select distinct on (region_id) * from latest order by region_id, {RANK} desc, disaster_type),
    listing as (select q.conv_id, q.turn, string_agg(concat(l.disaster_type, ' is ', l.risk_level, ' (', {_PCT.format('l.probability_pct')}, '% probability).',
            case when l.time_to_impact_h is not null then concat(' Expected impact in approximately ', {_PCT.format('l.time_to_impact_h')}, ' hour',
                case when l.time_to_impact_h = 1 then '' else 's' end, '.') else '' end), ' ' order by l.disaster_type) as txt
        from q join latest l on l.region_id = q.region_id and (q.hazard is null or q.hazard = l.disaster_type) group by 1, 2)
    select q.conv_id, q.turn, q.intent, q.region_id,
        case when q.intent = 'location_clarification' then {_quote(K.ANSWER_NO_PLACE)}
             when t.region_id is null then {_quote(K.ANSWER_NO_DATA)}
             when q.intent = 'risk_query' then case when li.txt is null then concat('I don''t have current prediction data for ', q.hazard, ' in that region.')
                 else concat('Current risk for ', q.region_id, ': ', li.txt) end
             when q.intent = 'safety_recommendation' then case t.risk_level
                 when 'High' then concat('It is NOT safe. There is a ', t.disaster_type, ' High risk alert (', {_PCT.format('t.probability_pct')}, '%). Avoid travel and follow official guidance.')
                 when 'Medium' then concat('Exercise caution. There is a ', t.disaster_type, ' Medium risk (', {_PCT.format('t.probability_pct')}, '%). Monitor official channels before travelling.')
                 else {_quote(K.ANSWER_LOW)} end
             when t.risk_level = 'High' then {_CARE} else {_quote(K.ANSWER_NO_ACTION)} end as answer
    from q left join top t on t.region_id = q.region_id left join listing li on li.conv_id = q.conv_id and li.turn = q.turn""")
def answers(load):
    asked = ask.classify(load("chat_queries"), board.known_regions(load("predictions")), KEYS)
    return ask.answers(asked, load("predictions")).select(*KEYS, "intent", "region_id", "answer")
