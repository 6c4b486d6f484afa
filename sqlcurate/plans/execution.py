"""Running candidate and gold statements on Spark.

Each distinct statement is analysed on the driver; what passes is a job of its own, with a tag, a scheduler pool and an
output folder. So a statement that fails or runs too long costs itself: nothing is run twice and no other statement
waits for it. Results go straight from the executors to a table, in as many tasks as the statement has.
"""

import itertools
import threading
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import contextmanager, nullcontext
from itertools import batched

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlcurate import schemas as S
from sqlcurate.functions.cells import cell_text
from sqlcurate.operators.results import cap_rows, mark_truncated
from sqlcurate.sources.storage import scratch_path

EMPTY = "Empty SQL query"
REFUSED = "Only SELECT statements are executed"
TIMED_OUT = "Query timed out"
# Fixed value: seconds a statement had in the runs whose reports are compared with. There is no limit unless asked for.
TIME_LIMIT = 5.0
# Outcomes written at a time.
WRITTEN_AT_ONCE = 1024

# Candidates are text written by a model. Nothing but a query may run, and no query may reach a
# shell, a Java method or a file.
FORBIDDEN = {"ScriptTransformation", "CallMethodViaReflection", "TryReflect", "Reflect"}
FILE_TABLES = "spark.sql.runSQLOnFiles"


def exec_id(db_id: Column, sql: Column) -> Column:
    """Equal statements on the same database share one execution."""
    return F.sha2(F.concat_ws("\x01", db_id, sql), 256)


def _listed(found) -> list:
    return [found.apply(i) for i in range(found.size())]


def _expressions(expression):
    yield expression
    for child in _listed(expression.children()):
        yield from _expressions(child)


def _nodes(plan):
    """Operators and expressions of a plan, without its subqueries."""
    yield plan
    for expression in _listed(plan.expressions()):
        yield from _expressions(expression)
    for child in _listed(plan.children()):
        yield from _nodes(child)


def analysed(session: SparkSession, statement) -> DataFrame:
    """Result of one statement as `(exec_id, row_no, vals)`; raises if it is no query that may run.

    The statement is placed in a subquery, where anything that is not a query does not parse. What
    it calls is then looked up in the analysed plan, so no spelling hides it. Row numbers follow
    the order of the result and have gaps.
    """
    body = statement.sql.strip().removesuffix(";")
    result = session.sql(f"SELECT * FROM (\n{body}\n)")
    plan = result._jdf.queryExecution().analyzed()
    if any(node.getClass().getSimpleName() in FORBIDDEN for part in [plan, *_listed(plan.subqueriesAll())] for node in _nodes(part)):
        raise ValueError(REFUSED)
    kinds = [field.dataType for field in result.schema.fields]
    named = result.toDF(*[f"c{i}" for i in range(len(kinds))])
    return named.select(
        F.lit(statement.exec_id).alias("exec_id"),
        F.monotonically_increasing_id().alias("row_no"),
        F.array(*[cell_text(F.col(f"c{i}"), kind) for i, kind in enumerate(kinds)]).alias("vals"),
    )


class Limit:
    """Ends statements that run longer than `seconds`; those that do not end are cancelled again until they do.

    A statement's time begins with its first task, so neither its analysis nor waiting for cores counts.
    """

    def __init__(self, context: SparkContext, seconds: float, every: float = 0.1):
        self.context, self.seconds, self.every = context, seconds, every
        self.first_task: dict[str, float | None] = {}
        self.late: set[str] = set()
        self.lock, self.over = threading.Lock(), threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def __enter__(self) -> "Limit":
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()

    @contextmanager
    def on(self, tag: str) -> Iterator[None]:
        with self.lock:
            self.first_task[tag] = None
        try:
            yield
        finally:
            with self.lock:
                del self.first_task[tag]

    def _began(self, tag: str) -> bool:
        tracker = self.context.statusTracker()
        jobs = (tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(tag))
        stages = (tracker.getStageInfo(stage) for job in jobs if job for stage in job.stageIds)
        return any(stage.numActiveTasks or stage.numCompletedTasks or stage.numFailedTasks for stage in stages if stage)

    def _watch(self) -> None:
        while not self.over.wait(self.every):
            with self.lock:
                running = dict(self.first_task)
            for tag, since in running.items():
                now = time.monotonic()
                if since is None and self._began(tag):
                    with self.lock:
                        if tag in self.first_task:
                            self.first_task[tag] = now
                elif since is not None and now - since > self.seconds:
                    self.late.add(tag)
                    self.context.cancelJobsWithTag(tag)


def _written(plan: DataFrame, path: str, tag: str, limit: Limit | None) -> str | None:
    """Write the result of a statement to `path`; returns the error text, if any."""
    context = plan.sparkSession.sparkContext
    context.setJobGroup(tag, "candidate statement", interruptOnCancel=True)
    context.addJobTag(tag)
    try:
        if limit is None:
            plan.write.parquet(path)
        else:
            with limit.on(tag):
                plan.write.parquet(path)
        return None
    except Exception as error:  # whatever goes wrong with a candidate is its result, not a fault of the job
        return f"{TIMED_OUT} after {limit.seconds}s" if limit and tag in limit.late else str(error).strip().split("\n")[0]
    finally:
        context.removeJobTag(tag)


def _run(statement, sessions: dict[str, SparkSession], path: str, limit: Limit | None) -> tuple:
    """Outcome `(exec_id, ok, error, truncated)` of a statement, whose result is written below `path`."""
    session = sessions.get(statement.db_id)
    try:
        if not (statement.sql or "").strip():
            raise ValueError(EMPTY)
        if session is None:
            raise ValueError(f"no such database: {statement.db_id}")
        plan = analysed(session, statement)
    except Exception as error:  # as above
        message = str(error).strip().split("\n")[0]
    else:
        message = _written(plan, f"{path}/rows/of={statement.exec_id}", f"statement-{uuid.uuid4().hex}", limit)
    return statement.exec_id, message is None, message, False


def _outcomes(statements: Iterator, sessions: dict[str, SparkSession], path: str, limit: Limit | None, in_flight: int) -> Iterator[tuple]:
    """Outcomes as statements end, `in_flight` at a time; the driver holds a few statements more than that.

    Each thread submits to a pool of its own, so under the fair scheduler quick statements get cores beside slow ones.
    """
    numbers, context = itertools.count(), next(iter(sessions.values())).sparkContext if sessions else None

    def to_pool() -> None:
        if context:
            context.setLocalProperty("spark.scheduler.pool", f"statements-{next(numbers)}")

    with ThreadPoolExecutor(in_flight, initializer=to_pool) as threads:
        pending = set()
        for statement in statements:
            pending.add(threads.submit(_run, statement, sessions, path, limit))
            if len(pending) >= 2 * in_flight:
                done, pending = wait(pending, return_when=FIRST_COMPLETED)
                yield from (one.result() for one in done)
        yield from (one.result() for one in pending)


def execute_statements(
    statements: DataFrame, sessions: dict[str, SparkSession],
    cap: int | None = None, timeout: float | None = None, in_flight: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """Run `statements(db_id, sql)`; returns `(executions, exec_rows)` with all rows of all results.

    `sessions` holds for each database a session with its tables as views. `in_flight` statements run at a time, each
    once. One that takes longer than `timeout` seconds, counted from its first task, has failed; TIME_LIMIT is the limit
    of the runs compared with. `cap` keeps the first rows of each result and marks longer ones; of a result without an
    order it keeps an arbitrary part, so prints of capped results only compare where both are ordered.
    """
    spark = statements.sparkSession
    path = scratch_path(spark, "executions")
    distinct = (
        statements.dropDuplicates(["db_id", "sql"])
        .select(exec_id(F.col("db_id"), F.col("sql")).alias("exec_id"), "db_id", "sql")
    )
    files = {name: session.conf.get(FILE_TABLES) for name, session in sessions.items()}
    for session in sessions.values():
        session.conf.set(FILE_TABLES, "false")
    try:
        with Limit(spark.sparkContext, timeout) if timeout else nullcontext() as limit:
            for some in batched(_outcomes(distinct.toLocalIterator(), sessions, path, limit, in_flight), WRITTEN_AT_ONCE):
                spark.createDataFrame(some, S.EXECUTIONS).coalesce(1).write.mode("append").parquet(f"{path}/outcomes")
    finally:
        for name, session in sessions.items():
            session.conf.set(FILE_TABLES, files[name])

    # One more file without rows, so that the folders can be read whatever ran.
    spark.createDataFrame([], S.EXECUTIONS).write.mode("append").parquet(f"{path}/outcomes")
    spark.createDataFrame([], S.EXEC_ROWS).write.parquet(f"{path}/rows/of=none")
    executions = spark.read.schema(S.EXECUTIONS).parquet(f"{path}/outcomes")
    # A job that fails may have committed some of its tasks, so rows count only where the statement has ended well.
    rows = spark.read.schema(S.EXEC_ROWS).parquet(f"{path}/rows").join(executions.filter("ok"), "exec_id", "left_semi")
    marked = mark_truncated(executions, rows, cap)
    return marked.select("exec_id", "ok", "error", "truncated", "n_kept"), rows if cap is None else cap_rows(rows, cap, dense=False)
