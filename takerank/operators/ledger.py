"""Votes, answers, dates and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from takerank.functions.columns import is_stem, overlap


VOTES = ("like", "star", "dislike")


def _undone(events: DataFrame) -> Column:
    """Whether an undo takes back a note."""
    return F.coalesce(F.col("deshace") == "nota", F.lit(False)) if "deshace" in events.columns else F.lit(False)


def vote_state(events: DataFrame, keys: list[str], tie: str = "event_id", kinds: tuple[str, ...] = ("like", "star")) -> DataFrame:
    """The vote in force for each key, with all its columns: an undo, but one of a note, takes it back, other events leave it as it is."""
    undo = (F.col("evento") == "undo") & ~_undone(events)
    rest = [c for c in events.columns if c not in keys]
    last = events.where(F.col("evento").isin(*kinds) | undo).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", tie)).alias("last"))
    return last.where(F.col("last.evento") != "undo").select(*keys, "last.*")


def note_state(events: DataFrame, keys: list[str], tie: str = "event_id") -> DataFrame:
    """The note in force for each key, with all its columns: only an undo of a note takes it back."""
    rest = [c for c in events.columns if c not in keys]
    last = events.where((F.col("evento") == "nota") | ((F.col("evento") == "undo") & _undone(events))).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", tie)).alias("last"))
    return last.where(F.col("last.evento") == "nota").select(*keys, "last.*")


def vote_counts(live: DataFrame, take: str = "toma", voter: str = "usuario") -> DataFrame:
    """Votes in force and voters of each take."""
    return live.groupBy(take).agg(F.count("*").alias("votes"), F.count_distinct(voter).alias("voters"))


def vote_coverage(votes: DataFrame, present: DataFrame, key: str, voter: str) -> DataFrame:
    """For votes by at least 1, 2 and 3 voters: how many keys there are and how many are present."""
    n = votes.groupBy(key).agg(F.count_distinct(voter).alias("voters"))
    n = n.join(present.select(key).distinct().withColumn("here", F.lit(1)), key, "left")
    g = n.agg(*[f.alias(f"{name}{k}") for k in (1, 2, 3) for name, f in (("n", F.count_if(F.col("voters") >= k)), ("p", F.count_if((F.col("voters") >= k) & F.col("here").isNotNull())))])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("least"), F.col(f"n{k}").alias("keys"), F.col(f"p{k}").alias("present")) for k in (1, 2, 3)])
    return g.select(F.explode(rows).alias("r")).select("r.*").withColumn("share", F.try_divide("present", "keys"))


def not_rescued(live: DataFrame, present: DataFrame, take: str = "toma") -> DataFrame:
    """Takes with votes in force that no compilation holds, with their voters."""
    return vote_counts(live, take).join(present.select(take).distinct(), take, "left_anti")


def rehome(votes: DataFrame, candidates: DataFrame) -> DataFrame:
    """vote_id with the candidate (toma, compilado, tramo, ini, fin) to which a vote (vote_id, toma, compilado, tramo, ini, fin) belongs.

    A candidate of the vote's compilation wins over others, whatever it shares with the stretch voted for;
    then the longest overlap, the nearest number, the smaller number and the first compilation decide. All null: no compilation holds
    the take. Votes for the same stretch have the same home, so only the distinct stretches meet the candidates.
    """
    place = ["toma", "compilado", "tramo", "ini", "fin"]
    c = candidates.select("toma", F.col("compilado").alias("c_comp"), F.col("tramo").alias("c_tramo"), F.col("ini").alias("c_ini"), F.col("fin").alias("c_fin"))
    j = votes.select(*place).distinct().join(c, "toma").withColumn("shared", overlap(F.col("ini"), F.col("fin"), F.col("c_ini"), F.col("c_fin")))
    other = F.coalesce(F.col("compilado") != F.col("c_comp"), F.lit(True))
    order = F.struct(other.alias("o"), (-F.col("shared")).alias("s"), F.abs(F.col("tramo") - F.col("c_tramo")).alias("n"), "c_tramo", "c_comp")
    best = j.groupBy(*place).agg(F.min_by(F.struct("c_comp", "c_tramo", "shared"), order).alias("b"))
    best = best.select(*[F.col(x).alias(f"b_{x}") for x in place], "b")
    out = votes.join(best, [F.col(x).eqNullSafe(F.col(f"b_{x}")) for x in place], "left")
    return out.select("vote_id", F.col("b.c_comp").alias("new_compilado"), F.col("b.c_tramo").alias("new_tramo"), F.col("b.shared").alias("shared"))


def corrections(votes: DataFrame, homes: DataFrame, now: Column) -> DataFrame:
    """Events that move votes and notes in force (vote_id, usuario, compilado, tramo, toma, evento, ts, ...) to their homes.

    A vote whose take is in no compilation is undone; one whose home has changed is undone and given again
    there, with all it held; one that is at home gives nothing. Undos of notes say so and name the note's time.
    """
    j = votes.join(homes, "vote_id")
    same = (F.col("new_compilado") == F.col("compilado")) & (F.col("new_tramo") == F.col("tramo"))
    lost, note = F.col("new_compilado").isNull(), F.col("evento") == "nota"
    none = {"deshace", "nota_ts", "migracion"}
    rest = [c for c in votes.columns if c not in {"vote_id", "evento", "compilado", "tramo", "ts"} | none]
    kind = dict(votes.dtypes)
    who = [c for c in rest if c in {"usuario", "banda", "toma"}]
    moved = F.concat(F.lit("to "), "new_compilado", F.lit(" "), F.col("new_tramo").cast("string"))
    undo = F.struct(
        *[(F.col(c) if c in who else F.lit(None).cast(kind[c])).alias(c) for c in rest], F.col("compilado").alias("compilado"), F.col("tramo").cast("long").alias("tramo"), now.alias("ts"),
        F.lit("undo").alias("evento"), F.when(note, "nota").alias("deshace"), F.when(note, F.col("ts")).alias("nota_ts"), F.when(lost, "in no compilation").otherwise(moved).alias("migracion"),
    )
    again = F.struct(
        *[F.col(c) for c in rest], F.col("new_compilado").alias("compilado"), F.col("new_tramo").cast("long").alias("tramo"), now.alias("ts"),
        F.col("evento"), F.lit(None).cast("string").alias("deshace"), F.lit(None).cast(kind["ts"]).alias("nota_ts"), F.concat(F.lit("from "), "compilado", F.lit(" "), F.col("tramo").cast("string")).alias("migracion"),
    )
    # at most two events a vote; what is at home is filtered first
    moves = j.where(lost | ~same)
    return moves.select("vote_id", F.explode(F.when(lost, F.array(undo)).otherwise(F.array(undo, again))).alias("e")).select("vote_id", "e.*")


#: The words of an answer.
ANSWERS = {"a": "A", "b": "B", "ambos": "ambos", "ambas": "ambos", "los dos": "ambos", "las dos": "ambos", "ninguno": "ninguno", "ninguna": "ninguno"}


def parse_answers(df: DataFrame, text: str) -> DataFrame:
    """df with number and choice of each answer in free text such as "LOTE 2 (x): 1 A, 2-b; 3=las dos"; what is no answer is marked bad."""
    body = F.regexp_replace(F.col(text), r"(?i)^\s*lote\s*\d+\s*(?:\([^)]*\))?\s*:\s*", "")
    token = F.explode(F.filter(F.transform(F.split(body, r"[,;\n]+"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != ""))
    out = df.withColumn("token", token)
    pattern = r"(?i)^(\d+)\s*[:=-]?\s*(" + "|".join(ANSWERS) + r")$"
    word, number = F.lower(F.regexp_extract("token", pattern, 2)), F.regexp_extract("token", pattern, 1)
    choice = F.element_at(F.create_map(*[F.lit(x) for kv in ANSWERS.items() for x in kv]), F.nullif(word, F.lit("")))
    return out.withColumns({"num": F.when(number != "", number).cast("long"), "choice": choice, "bad": number == ""})


def sessions(df: DataFrame, keys: list[str], ts: str, hours: float = 12.0) -> DataFrame:
    """df with the number of its session: a gap of more than so many hours begins a new one."""
    order = W.Window.partitionBy(*keys).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(order)
    return df.withColumn("_new", F.coalesce((gap > int(hours * 3.6e9)).cast("long"), F.lit(0))).withColumn("session", F.sum("_new").over(order)).drop("_new")


def last_session(df: DataFrame, ts: str, hours: float = 12.0) -> DataFrame:
    """The newest row and those before it that chain to it with gaps of at most so many hours.

    The chain ends after the last long gap. A gap is long if a row's successor is too far off; it is
    looked for between the ends of days first, so that no task sorts all rows.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    day = F.floor(us / 86_400_000_000)
    rows = df.withColumn("_us", us).withColumn("_day", day)
    limit = int(hours * 3.6e9)
    inside = F.lag("_us").over(W.Window.partitionBy("_day").orderBy("_us"))
    in_day = rows.withColumn("_gap", F.col("_us") - inside).groupBy("_day").agg(F.min("_us").alias("lo"), F.max("_us").alias("hi"), F.max(F.when(F.col("_gap") > limit, F.col("_us"))).alias("cut"))
    between = in_day.withColumn("before", F.lag("hi").over(W.Window.orderBy("_day")))  # one row a day
    cut = between.agg(F.max(F.greatest("cut", F.when(F.col("lo") - F.col("before") > limit, F.col("lo")))).alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).where(F.col("cut").isNull() | (F.col("_us") >= F.col("cut"))).drop("_us", "_day", "cut")


def in_range(df: DataFrame, ts: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows with a date, from since on and before until."""
    out = df.where(F.col(ts).isNotNull())
    out = out.where(F.col(ts) >= F.lit(since).cast(dict(df.dtypes)[ts])) if since else out
    return out.where(F.col(ts) < F.lit(until).cast(dict(df.dtypes)[ts])) if until else out


def in_year(df: DataFrame, ts: str, year: int) -> DataFrame:
    return in_range(df, ts, f"{year}-01-01", f"{year + 1}-01-01")


def stale(listing: DataFrame, cache: DataFrame, params: dict, retry_errors: bool = False) -> DataFrame:
    """Files of a listing (path, mtime, size) that the cache does not hold fresh under these parameters."""
    ok = ["ok"] if retry_errors else ["ok", "error"]
    c = cache.where(F.col("status").isin(*ok))
    for k, v in params.items():
        c = c.where(F.col(k) == v)
    c = c.select(F.col("path").alias("c_path"), F.col("mtime").alias("c_mtime"), F.col("size").alias("c_size"))
    return listing.join(c, (F.col("path") == F.col("c_path")) & (F.col("size") == F.col("c_size")) & (F.abs(F.col("mtime") - F.col("c_mtime")) <= 1e-6), "left_anti")


def remote_wanted(listing: DataFrame, since: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Remote audio files (path, name, ts) since a date, outside excluded folders, no stems or resource forks."""
    out = listing.where(~is_stem(F.col("name")) & ~F.col("name").startswith("._"))
    out = in_range(out, "ts", since) if since else out
    for folder in excluded:
        out = out.where((F.col("path") != folder) & ~F.col("path").startswith(folder.rstrip("/") + "/"))
    return out


def classify(remote: DataFrame, manifest: DataFrame, local: DataFrame) -> DataFrame:
    """remote (id, name, size, modtime) with state: manifest (known and unchanged), local (same name and size here) or download."""
    m = manifest.select(F.col("id").alias("m_id"), F.col("size").alias("m_size"), F.col("modtime").alias("m_mod"))
    here = local.select("name", "size").distinct().withColumn("here", F.lit(1))
    j = remote.join(m, (F.col("id") == F.col("m_id")) & (F.col("size") == F.col("m_size")) & (F.col("modtime") == F.col("m_mod")), "left").join(here, ["name", "size"], "left")
    state = F.when(F.col("m_id").isNotNull(), "manifest").when(F.col("here").isNotNull(), "local").otherwise("download")
    return j.withColumn("state", state).select(*remote.columns, "state")


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key: an upsert over an append-only table."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def nearest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the last value of right strictly before its time: a union and one window, no range join."""
    l = left.withColumns({"_t": F.col(at), "_side": F.lit(0), "_v": F.lit(None).cast(dict(right.dtypes)[value])})  # noqa: E741
    r = right.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.col(value).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = W.Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.Window.unboundedPreceding, 0)
    return both.withColumn("matched", F.last("_v", ignorenulls=True).over(order)).where("_side = 0").drop("_t", "_side", "_v")
