"""A ledger of model calls: answers are kept by prompt and model, so that nothing is asked twice.

Prompts that the ledger has no answer for are asked in waves; each wave is written before the next begins, so a run that
dies loses one wave at most, and a second run asks only what is missing. A call has a time limit and is tried a few times;
what still fails becomes a row with its error, which a later run tries again.

Defined cases: equal prompts are asked once, whatever rows have them; a null prompt is not asked and has no answer; a model
that returns None for a prompt, or the wrong number of answers, has failed on it; a batch that fails is asked prompt by
prompt; an empty table asks nothing. Of several answers of one prompt, as after two runs side by side, the smallest holds.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import Model

#: Prompts of one wave and of one call, and tries of a call.
WAVE, BATCH, TRIES = 2_000, 16, 3
LEDGER = "prompt_hash string, answer string, error string, tries int"


class Ledger:
    """Answers below a folder that all nodes share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _waves(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        """One row a prompt and model: its answer, or its last error where it has none."""
        waves = [self.spark.read.schema(LEDGER).parquet(f"{self.root}/{n}").withColumn("wave", F.lit(n)) for n in self._waves()]
        rows = functools.reduce(DataFrame.unionByName, waves) if waves else self.spark.createDataFrame([], f"{LEDGER}, wave int")
        return rows.groupBy("prompt_hash").agg(F.min("answer").alias("answer"), F.max_by("error", "wave").alias("error"), F.sum("tries").alias("tries"))

    def answered(self, prompts: DataFrame, model: Model, name: str, timeout: float = 120.0, tries: int = TRIES, rate: float | None = None, wave: int = WAVE, batch: int = BATCH) -> DataFrame:
        """`prompts` (with a column `prompt`) with `answer` and `error`. `name` says which model it is; `rate` bounds the calls a second of a task."""
        hashed = F.sha2(F.concat(F.lit(f"{name}\n"), F.col("prompt")), 256)
        asked = prompts.withColumn("prompt_hash", hashed)
        done = self.read().filter("answer IS NOT NULL").select("prompt_hash")
        missing = asked.filter("prompt IS NOT NULL").select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"]).join(done, "prompt_hash", "left_anti")
        n = missing.count()
        waves = -(-n // wave)
        if waves:
            path = max(self._waves(), default=0) + 1
            missing.select("*", F.pmod(F.xxhash64("prompt_hash"), F.lit(waves)).alias("wave")).write.partitionBy("wave").parquet(f"{self.root}-asked/{path}")
            todo = self.spark.read.schema("prompt_hash string, prompt string, wave int").parquet(f"{self.root}-asked/{path}")
            for k in range(waves):
                rows = todo.filter(F.col("wave") == k).select("prompt_hash", "prompt").repartition(max(1, wave // (4 * batch)))
                rows.mapInPandas(functools.partial(_ask, model=model, timeout=timeout, tries=tries, rate=rate, batch=batch), LEDGER).write.parquet(f"{self.root}/{path + k}")
        return asked.join(self.read().select("prompt_hash", "answer", "error"), "prompt_hash", "left").drop("prompt_hash")


def _ask(batches: Iterator[pd.DataFrame], model: Model, timeout: float, tries: int, rate: float | None, batch: int) -> Iterator[pd.DataFrame]:
    pool, last = ThreadPoolExecutor(1), 0.0

    def call(prompts: list[str]) -> list[str]:
        nonlocal pool, last
        if rate:
            time.sleep(max(0.0, last + 1 / rate - time.monotonic()))
            last = time.monotonic()
        future = pool.submit(model, prompts)
        try:
            answers = list(future.result(timeout))
        except TimeoutError:
            pool.shutdown(wait=False)  # the call that hangs keeps its thread, the next gets another
            pool = ThreadPoolExecutor(1)
            raise TimeoutError(f"no answer within {timeout:g} s") from None
        if len(answers) != len(prompts) or any(a is None for a in answers):
            raise ValueError("an answer is missing")
        return answers

    def one(prompt: str) -> tuple[str | None, str | None, int]:
        for k in range(1, tries + 1):
            try:
                return call([prompt])[0], None, k
            except Exception as e:  # whatever a model raises is its failure, kept as a row
                error = f"{type(e).__name__}: {e}"[:1000]
        return None, error, tries

    for b in batches:
        for at in range(0, len(b), batch):
            part = b.iloc[at : at + batch]
            prompts = part["prompt"].tolist()
            try:
                rows = [(a, None, 1) for a in call(prompts)]
            except Exception:
                rows = [one(p) for p in prompts]
            answer, error, n = zip(*rows)
            yield pd.DataFrame({"prompt_hash": part["prompt_hash"].tolist(), "answer": answer, "error": error, "tries": n})
