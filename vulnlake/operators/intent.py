"""Malicious-intent step.

No model client ships with the library: ``score`` takes the caller's
function and runs it batch-wise in ``mapInPandas`` (one call per Arrow
batch, partitions in parallel).  ``intent_signals`` is the rule form of the
prompt's own factors and runs entirely on Spark expressions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.functions.text import fenced_json_or_all
from vulnlake.operators import chunks
from vulnlake.session import scratch_dir, small_batch_bytes

# The factors the intent prompt names.
INTENT_WORDS = ["backdoor", "sabotage", "malicious code"]
INTENT_TAGS = ["exploit", "malware", "backdoor"]
PARSE_FAIL = "Could not parse model JSON output: "


def parse_intent(text: Column) -> Column:
    """``{malicious_intent_likely, reason}`` from the (lenient, X04) JSON; anything
    unparseable gives ``false`` and a reason starting ``Could not parse`` with the raw text."""
    body = fenced_json_or_all(text)
    v = F.try_parse_json(body)
    flag = F.try_variant_get(v, "$.malicious_intent_likely", "boolean")
    reason = F.try_variant_get(v, "$.reason", "string")
    ok = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    return F.when(ok, F.struct(F.coalesce(flag, F.lit(False)).alias("malicious_intent_likely"), reason.alias("reason"))) \
            .otherwise(F.struct(F.lit(False).alias("malicious_intent_likely"),
                                F.concat(F.lit(PARSE_FAIL), text).alias("reason")))


def intent_signals(df: DataFrame, description: str = "description", tags: str = "tags") -> DataFrame:
    """X11: flag = any intent word in the lower-cased description or any intent tag;
    ``reason`` lists the matched words and tags."""
    d = F.lower(F.coalesce(F.col(description), F.lit("")))
    words = F.filter(F.array(*[F.lit(w) for w in INTENT_WORDS]), lambda w: F.contains(d, w))
    t = F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda x: F.lower(x))
    tag_hits = F.filter(F.array(*[F.lit(w) for w in INTENT_TAGS]), lambda w: F.array_contains(t, w))
    hits = F.array_union(words, tag_hits)
    return df.withColumn("malicious_intent_likely", F.size(hits) > 0) \
             .withColumn("reason", F.array_join(hits, ", "))


PROMPT_HEAD = "Decide whether this vulnerability was likely introduced on purpose.\n\nCVE Description: "
PROMPT_TAIL = ("Look for words such as backdoor, sabotage or malicious code, and tags such as exploit, malware or "
               "backdoor. Reply with ```json {\"malicious_intent_likely\": true/false, \"reason\": \"...\"} ```.")


def intent_prompt_chunks(cves: DataFrame, refs: DataFrame, scraped: DataFrame | None = None, key: str = "cve_id",
                         most: int = chunks.MOST) -> DataFrame:
    """X10 as (key, chunk, text): description, one line per reference ``- URL: u, Tags: [a, b]``
    (missing url ``N/A``) each followed by any scraped text of that URL, in reference order, then
    the instructions.  The references of a CVE are placed by offsets and meet in chunks of
    about ``most`` bytes (``operators.chunks``), never in one task."""
    url = F.coalesce(F.col("url"), F.lit("N/A"))
    line = F.concat(F.lit("- URL: "), url, F.lit(", Tags: ["),
                    F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), ", "), F.lit("]\n"))
    r = refs
    if scraped is not None:
        r = r.join(scraped.select(key, "url", "scraped_text"), [key, "url"], "left")
        line = F.concat(line, F.when(F.col("scraped_text").isNotNull(), F.concat(
            F.lit("\n---\nScraped Content from "), url, F.lit(":\n"), F.col("scraped_text"), F.lit("\n---\n")))
            .otherwise(F.lit("")))
    head = F.concat(F.lit(PROMPT_HEAD), F.coalesce(F.col("description"), F.lit("")), F.lit(".\n\nReferences:\n"))
    ends = cves.select(key, F.explode(F.array(F.struct(F.lit(FIRST).alias("pos"), head.alias("text")),
                                              F.struct(F.lit(LAST).alias("pos"), F.lit(PROMPT_TAIL).alias("text")))).alias("e"))
    lines = r.join(cves.select(key), key, "left_semi").select(key, F.col("pos").cast("long").alias("pos"), line.alias("text"))
    return chunks.text_chunks(ends.select(key, "e.pos", "e.text").unionByName(lines), key, "pos", "text", most)


#: Orders before and after every reference.
FIRST, LAST = -(1 << 40), 1 << 40


def intent_prompt(cves: DataFrame, refs: DataFrame, scraped: DataFrame | None = None, key: str = "cve_id") -> DataFrame:
    """The chunks of ``intent_prompt_chunks`` as one prompt for each CVE, for a model."""
    return chunks.folded(intent_prompt_chunks(cves, refs, scraped, key), key).withColumnRenamed("text", "prompt")


def answers(fn: Callable, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt: one call of ``fn``; if that fails, one for each prompt."""
    def alone(prompt):
        try:
            return list(fn([prompt]))[0], None
        except Exception as e:  # noqa: BLE001 - the caller's function may raise anything
            return None, f"{type(e).__name__}: {e}"
    try:
        found = [(r, None) for r in fn(prompts)]
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} replies to {len(prompts)} prompts")
    except Exception:  # noqa: BLE001 - then each prompt on its own
        found = [alone(p) for p in prompts]
    return found


def score(df: DataFrame, prompt_col: str, fn: Callable, out_col: str = "reply") -> DataFrame:
    """Run the caller's ``fn(list[str]) -> list[str]`` over the prompt column, one
    call per Arrow batch inside ``mapInPandas``; a batch is bounded in bytes, not only in rows.  A
    batch that fails is tried again prompt by prompt; only a prompt that fails alone has a null
    reply, with the error in ``<out_col>_error``."""
    small_batch_bytes(df.sparkSession)
    error_col = f"{out_col}_error"
    schema = T.StructType([f for f in df.schema.fields if f.name not in (out_col, error_col)]
                          + [T.StructField(out_col, T.StringType()), T.StructField(error_col, T.StringType())])

    def run(batches):
        for pdf in batches:
            found = answers(fn, pdf[prompt_col].tolist())
            pdf[out_col] = [r for r, _ in found]
            pdf[error_col] = [e for _, e in found]
            yield pdf

    return df.mapInPandas(run, schema)


REPLIES = "prompt_hash string, reply string, error string"
#: Writer options of the reply table: a task's file is there as soon as the task ends.
STORED = {"compression": "zstd", "mapreduce.fileoutputcommitter.algorithm.version": "2"}


def score_stored(df: DataFrame, prompt_col: str, fn: Callable, store: str, out_col: str = "reply",
                 among: Callable[[Column], Column] | None = None) -> DataFrame:
    """U02 with a durable reply table: every distinct prompt is sent once and its reply kept in the
    parquet table ``store`` under the prompt's SHA-256; a prompt with a stored reply is not
    sent again, by this run or a later one.

    A task's replies are in the table as soon as the task ends, so a job that fails, or an
    executor that is lost, costs the replies of unfinished tasks only.  A prompt that failed is
    stored with its error and sent again by the next run.  A null prompt is not sent.
    ``among``: a test of a prompt's hash that all prompts of ``df`` pass; replies to others are not looked at."""
    spark = df.sparkSession
    spark.createDataFrame([], REPLIES).write.mode("append").parquet(store)

    def replies() -> DataFrame:
        r = spark.read.schema(REPLIES).parquet(store)
        return r if among is None else r.where(among(F.col("prompt_hash")))
    hashed = df.withColumn("prompt_hash", F.sha2(F.col(prompt_col), 256))
    asked = hashed.where(F.col("prompt_hash").isNotNull()).select("prompt_hash", F.col(prompt_col).alias("prompt")).dropDuplicates(["prompt_hash"])
    todo = asked.join(replies().where(F.col("reply").isNotNull()).select("prompt_hash"), "prompt_hash", "left_anti")
    (score(todo, "prompt", fn, "reply").select("prompt_hash", "reply", F.col("reply_error").alias("error"))
     .write.mode("append").options(**STORED).parquet(store))
    # a second reader: the first one's file list is from before the write
    best = replies().groupBy("prompt_hash").agg(F.min("reply").alias(out_col), F.min("error").alias("_error"))
    error = F.when(F.col(out_col).isNull(), F.col("_error")).alias(f"{out_col}_error")
    return hashed.drop(out_col, f"{out_col}_error").join(best, "prompt_hash", "left").select(
        *[c for c in df.columns if c not in (out_col, f"{out_col}_error")], out_col, error)


#: Bits by which prompts are known as met before, and of one row of them.
MET, MET_ROW = 1 << 26, 1 << 15


def met_before(hashes: DataFrame, store: str) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of at most ``MET`` bits (numbers of its rows, rows): the bits of all hashes that stand on several rows of
    ``hashes`` (prompt_hash) or have a stored reply.  Other hashes may share these bits."""
    number = F.conv(F.substring("prompt_hash", 1, 15), 16, 10).cast("long").alias("number")
    stored = hashes.sparkSession.read.schema(REPLIES).parquet(store).where(F.col("reply").isNotNull()).select(number).distinct()
    often = hashes.where(F.col("prompt_hash").isNotNull()).select(number).unionAll(stored).groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bit = F.col("number") % MET
    found = (often.groupBy(F.floor(bit / MET_ROW).alias("row")).agg(F.bitmap_construct_agg((bit % MET_ROW).cast("long")).alias("bits"))
             .orderBy("row").collect())
    return np.array([r["row"] for r in found], np.int64), np.array([np.frombuffer(r["bits"], np.uint8) for r in found]).reshape(len(found), MET_ROW // 8)


def is_met(hashes: pd.Series, met: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which hashes have their bit in the bitmap of ``met_before``; null has none."""
    number, bits = met
    if not len(number):
        return np.zeros(len(hashes), bool)
    at = np.array([-1 if h is None else int(h[:15], 16) % MET for h in hashes], np.int64)
    row, bit = at // MET_ROW, at % MET_ROW
    k = np.minimum(np.searchsorted(number, row), len(number) - 1)
    return (number[k] == row) & (bits[k, bit // 8] >> (bit % 8) & 1 == 1)


def score_round(df: DataFrame, prompt_col: str, fn: Callable, store: str, ok: Callable[[Column], Column]) -> DataFrame:
    """A round of ``score_until``: the rows with ``reply``, ``reply_error`` and ``_good``, from the shared folder.

    A prompt that stands on one row and has no stored reply is asked where its row is, and the reply goes into ``store``
    together with the row: no text is shuffled, and the round's rows are not written once more.  The other rows, and the few that
    ``met_before`` can't tell from them, go into ``store`` without a reply and meet theirs by ``score_stored``."""
    spark = df.sparkSession
    small_batch_bytes(spark)
    spark.createDataFrame([], REPLIES).write.mode("append").parquet(store)
    df = df.drop("reply", "reply_error")
    # a column that is null by type can't be written
    kept = {c: f"row_{i}" for i, c in enumerate(df.columns) if not isinstance(df.schema[c].dataType, T.NullType)}
    back = [F.col(kept[c]).alias(c) if c in kept else F.lit(None).alias(c) for c in df.columns]
    text = F.col(prompt_col) if prompt_col in kept else F.lit(None).cast("string")
    hashed = df.select(F.sha2(text, 256).alias("prompt_hash"), text.alias("prompt"), *[F.col(c).alias(x) for c, x in kept.items()])
    met = met_before(hashed.select("prompt_hash"), store)

    @F.pandas_udf("waits boolean, reply string, error string")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hashes, prompts in batches:
            waits = is_met(hashes, met)
            here = ~waits & prompts.notna().to_numpy()
            found = iter(answers(fn, prompts[here].tolist()) if here.any() else [])
            out = [next(found) if h else (None, None) for h in here]
            yield pd.DataFrame({"waits": waits, "reply": [r for r, _ in out], "error": [e for _, e in out]})
    part = uuid.uuid4().hex
    good = F.coalesce(ok(F.col("reply")), F.lit(False))  # an unknown answer is not ok, and no row is lost
    asked = hashed.withColumn("found", ask.asNondeterministic()("prompt_hash", "prompt"))
    asked = asked.select("prompt_hash", "found.reply", "found.error", F.lit(part).alias("round"), "found.waits", *kept.values())
    asked = asked.withColumn("_good", good)
    asked.write.mode("append").options(**STORED).parquet(store)
    mine = spark.read.schema(asked.schema).parquet(store).where(F.col("round") == part)
    out = mine.where(~F.col("waits")).select(*back, "reply", F.col("error").alias("reply_error"), "_good")
    if not len(met[0]):
        return out
    among = F.pandas_udf(lambda hashes: pd.Series(is_met(hashes, met)), "boolean")
    later = score_stored(mine.where("waits").select(*back), prompt_col, fn, store, among=among).withColumn("_good", good)
    path = scratch_dir(spark, "scored")
    later.select(*[F.col(c).alias(x) for c, x in kept.items()], "reply", F.col("reply_error").alias("error"), "_good").write.option("compression", "zstd").parquet(path)
    later = spark.read.parquet(path).select(*back, "reply", F.col("error").alias("reply_error"), "_good")
    return out.unionByName(later)


def score_until(df: DataFrame, prompt_col: str, fn: Callable, ok: Callable[[Column], Column],
                retry_prompt: Callable[[DataFrame], DataFrame], rounds: int = 2, key: str = "cve_id",
                store: str | None = None) -> DataFrame:
    """Score, then re-score only the rows whose reply is not ``ok`` with a correction
    prompt, up to ``rounds`` more times.  Each round is a filtered DataFrame; only
    still-failing rows reach ``fn`` again.

    Replies are kept in the table ``store`` (by default a fresh one in the shared folder; see
    ``score_stored``): given the same table, a run after a failure asks only what was not answered.
    The rows of a round stand there beside their replies (``score_round``)."""
    store = store or scratch_dir(df.sparkSession, "replies")
    cur = score_round(df, prompt_col, fn, store, ok)
    done = cur.where("_good")
    for _ in range(rounds):
        cur = score_round(retry_prompt(cur.where(~F.col("_good")).drop("reply", "reply_error", "_good")), prompt_col, fn, store, ok)
        done = done.unionByName(cur.where("_good"))
    return done.unionByName(cur.where(~F.col("_good"))).drop("_good")


# ---------------------------------------------------------------- U01: HTML to text
from html.parser import HTMLParser  # noqa: E402

# Elements whose text is not page text.
SKIP_TAGS = {"script", "style", "template"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TAGS:
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in SKIP_TAGS and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            s = data.strip()
            if s:
                self.parts.append(s)


def html_to_text(html: str | None) -> str | None:
    """The page's strings, each stripped, empty ones dropped, joined by one space;
    script, style, template, comments and doctype excluded."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return " ".join(p.parts)


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """``html_to_text`` over a column, one Arrow batch at a time."""
    return s.map(html_to_text)


def with_intent(df: DataFrame, text: str, out: str = "p") -> DataFrame:
    """X07 as staged projections: extract, parse once, then read the fields."""
    d = df.withColumn("_pi_b", fenced_json_or_all(F.col(text)))
    d = d.withColumn("_pi_v", F.try_parse_json(F.col("_pi_b")))
    d = d.withColumn("_pi_ok", F.col("_pi_v").isNotNull() & F.schema_of_variant(F.col("_pi_v")).startswith("OBJECT"))
    flag = F.try_variant_get(F.col("_pi_v"), "$.malicious_intent_likely", "boolean")
    reason = F.try_variant_get(F.col("_pi_v"), "$.reason", "string")
    res = F.when(F.col("_pi_ok"), F.struct(F.coalesce(flag, F.lit(False)).alias("malicious_intent_likely"),
                                           reason.alias("reason"))) \
           .otherwise(F.struct(F.lit(False).alias("malicious_intent_likely"),
                               F.concat(F.lit(PARSE_FAIL), F.col(text)).alias("reason")))
    return d.withColumn(out, res).drop("_pi_b", "_pi_v", "_pi_ok")
