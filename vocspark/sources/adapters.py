"""Message tables made from the given tables: each a view with the columns that operators take.

``from_events`` has one message per event, ``from_conversations`` one per turn with its reply
links. Both put a template in front of the text, so that keyword rules have something to find.
The SQL constants state the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEMPLATES = (
    "@AppleSupport my app keeps crashing after the latest update https://t.co/a1",
    "Order delivery is delayed again and tracking is stuck, terrible service",
    "I was charged twice on my invoice, need the payment fixed",
    "Cannot login to my account, password reset link not working",
    "Please cancel my return, this dispute claim is horrible",
    "Phone battery power drain and overheating after charging",
    "Thanks for the great help, all resolved, love it!",
    "We'd like to help. Please DM us your account details ^RR",
    "Obrigado, mas o meu pedido não chegou e a fatura está errada",
    "Hola, necesito la devolución de mi pago, gracias",
    "Bonjour, je voudrais un remboursement de ma commande, merci",
    "Danke, aber die Lieferung und Rückerstattung fehlen, bitte helfen",
    "アプリが動かない",
    "Internet connection is down 😡 wifi signal outage in my area",
    "What are your opening hours today?",
    "iPhone slow and the screen freezes, worst support 🔋",
)

EVENT_TOPICS = {"error": "crash, freeze, bug, glitch", "purchase": "billing, charge, invoice, payment", "signup": "login, password, auth, 2fa", "click": "delivery, order, tracking, delay"}


def _template(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TEMPLATES)), (number % 16 + 1).cast("int"))


def _pick(number: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp"))
    i, u = F.col("event_id"), F.col("user_id")
    topic = F.lit("General Support")
    for kind, keywords in EVENT_TOPICS.items():
        topic = F.when(F.col("event_type") == kind, keywords).otherwise(topic)
    return e.select(
        i.alias("tweet_id"),
        F.concat(u.cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("conversation_id"),
        F.concat(F.lit("user_"), u.cast("string")).alias("author_id"),
        (F.col("event_type") != "view").alias("inbound"),
        F.col("ts").alias("created_at"),
        _template(i).alias("text"),
        _pick(i, ("negative", "neutral", "positive")).alias("sentiment"),
        (i % 3 - 1).cast("int").alias("sentiment_score"),
        (F.lit(0.5) + (i % 50) / 100).alias("confidence"),
        F.when(i % 10 == 0, "urgent").when(i % 10 == 1, "high").otherwise("normal").alias("priority"),
        topic.alias("topic_keywords"),
        F.col("value").alias("response_time_minutes"),
        _pick(u, ("Acme", "Borealis", "Cobalt", "Dune", "Ember", "Fjord", "4711")).alias("company"),
        F.concat(F.lit("product_"), (u % 11).cast("string")).alias("product"),
        _pick(u, ("north america", "europe", "asia", "latam", "africa")).alias("region"),
        _pick(i, ("resolved", "open", "closed", "pending", "open")).alias("resolution_status"),
        (i % 4 == 0).alias("fcr"),
        (i % 7 == 0).alias("escalated"),
        (i % 9 == 0).alias("reopened"),
        F.when(F.dayofmonth("ts") <= 15, "run_a").otherwise("run_b").alias("dataset_run_id"),
        F.get_json_object("props", "$.k").cast("int").alias("impressions"),
    )


def from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role <> 'system'")
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("n", F.row_number().over(by_turn)).withColumn("k", F.count("*").over(Window.partitionBy("conv_id")))
    v, n = F.col("conv_id"), F.col("n")
    minutes = (v * 887) % 40320 + n * (3 + v % 50)
    return c.select(
        (v * 100 + n).alias("tweet_id"),
        F.when(F.col("role") == "user", F.concat(F.lit("cust_"), (v % 20).cast("string"))).otherwise(F.concat(F.lit("agent_"), (v % 5).cast("string"))).alias("author_id"),
        (F.col("role") == "user").alias("inbound"),
        F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("created_at"),
        F.concat(_template(v + n), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"),
        F.when(n < F.col("k"), (v * 100 + n + 1).cast("string")).alias("response_tweet_id"),
        F.when(n > 1, v * 100 + n - 1).alias("in_response_to_tweet_id"),
        _pick(v + n, ("negative", "neutral", "positive")).alias("sentiment"),
        ((v + n) % 3 - 1).cast("int").alias("sentiment_score"),
        (F.lit(0.5) + ((v + n) % 50) / 100).alias("confidence"),
        F.when((v + n) % 4 == 0, "high").otherwise("normal").alias("priority"),
    )


def threaded(messages: DataFrame) -> DataFrame:
    """``from_conversations`` with the conversation that its ids spell out."""
    return messages.withColumn("conversation_id", (F.floor(F.col("tweet_id") / 100) * 100 + 1).cast("string"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_T = "[" + ", ".join(map(_sql_text, TEMPLATES)) + "]"

EVENTS_SQL = f"""ev as (select event_id as tweet_id, user_id || '-' || strftime(ts, '%Y-%m-%d') as conversation_id, 'user_' || user_id as author_id,
  event_type <> 'view' as inbound, ts as created_at, {_T}[1 + event_id % 16] as text,
  ['negative', 'neutral', 'positive'][1 + event_id % 3] as sentiment, cast(event_id % 3 - 1 as integer) as sentiment_score, 0.5 + (event_id % 50) / 100 as confidence,
  case when event_id % 10 = 0 then 'urgent' when event_id % 10 = 1 then 'high' else 'normal' end as priority,
  case event_type when 'error' then 'crash, freeze, bug, glitch' when 'purchase' then 'billing, charge, invoice, payment' when 'signup' then 'login, password, auth, 2fa' when 'click' then 'delivery, order, tracking, delay' else 'General Support' end as topic_keywords,
  value as response_time_minutes, ['Acme', 'Borealis', 'Cobalt', 'Dune', 'Ember', 'Fjord', '4711'][1 + user_id % 7] as company, 'product_' || (user_id % 11) as product,
  ['north america', 'europe', 'asia', 'latam', 'africa'][1 + user_id % 5] as region, ['resolved', 'open', 'closed', 'pending', 'open'][1 + event_id % 5] as resolution_status,
  event_id % 4 = 0 as fcr, event_id % 7 = 0 as escalated, event_id % 9 = 0 as reopened, case when day(ts) <= 15 then 'run_a' else 'run_b' end as dataset_run_id,
  cast(json_extract_string(props, '$.k') as integer) as impressions from events)"""

CONVERSATIONS_SQL = f"""cv0 as (select conv_id as v, role, text, row_number() over (partition by conv_id order by turn) as n, count(*) over (partition by conv_id) as k from conversations where role <> 'system'),
cv as (select v * 100 + n as tweet_id, case when role = 'user' then 'cust_' || (v % 20) else 'agent_' || (v % 5) end as author_id, role = 'user' as inbound,
  timestamp '2024-01-01' + to_minutes(cast((v * 887) % 40320 + n * (3 + v % 50) as bigint)) as created_at, {_T}[1 + (v + n) % 16] || ' ' || coalesce(text, '') as text,
  case when n < k then cast(v * 100 + n + 1 as varchar) end as response_tweet_id, case when n > 1 then v * 100 + n - 1 end as in_response_to_tweet_id,
  ['negative', 'neutral', 'positive'][1 + (v + n) % 3] as sentiment, cast((v + n) % 3 - 1 as integer) as sentiment_score, 0.5 + ((v + n) % 50) / 100 as confidence,
  case when (v + n) % 4 = 0 then 'high' else 'normal' end as priority, cast(v * 100 + 1 as varchar) as conversation_id from cv0)"""
