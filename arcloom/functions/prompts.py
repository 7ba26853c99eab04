"""Naming features and modules through an injected text generator, and the pipeline that edits features.

No model is called here: ``generate`` is any function from prompts to replies. The default one makes
names from the words of the methods, so that results can be repeated.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Generate = Callable[[list[str]], list[str]]


def from_words(prompts: list[str]) -> list[str]:
    """A reply from the commonest words of each prompt's names."""
    out = []
    for p in prompts:
        words = Counter(w.lower() for w in re.findall(r"[A-Z]?[a-z]{3,}", p.split("\n", 1)[-1]))
        out.append(" and ".join(w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:3]) or "unnamed")
    return out


def with_retry(call: Callable, retries: int = 5, first: float = 0.5, most: float = 8.0, sleep: Callable[[float], None] = time.sleep):
    """Calls again after rate limits and upstream failures, waiting twice as long each time with some jitter; others pass through."""
    wait = first
    for n in range(retries):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if n == retries - 1 or not re.search(r"429|rate ?limit|upstream", str(e), re.I):
                raise
            sleep(wait * (1 + random.random() / 4))
            wait = min(wait * 2, most)


def feature_prompts(methods: DataFrame) -> DataFrame:
    """(feature, prompt) from (feature, pos, name): the methods in order under a fixed heading."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: F.concat(F.lit("- "), x["name"])), "\n")
    return methods.groupBy("feature").agg(F.concat(F.lit("Describe in one sentence what these methods do together.\n"), listed).alias("prompt"))


def describe(prompts: DataFrame, key: str, generate: Generate = from_words) -> DataFrame:
    """(key, description) by ``generate``, a batch at a time; an empty reply is asked for again, up to three times."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = list(generate(list(b["prompt"])))
            for _ in range(3):
                empty = [i for i, x in enumerate(got) if not (x or "").strip()]
                if not empty:
                    break
                for i, x in zip(empty, generate([b["prompt"].iloc[i] for i in empty])):
                    got[i] = x
            yield pd.DataFrame({key: b[key], "description": got})

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, description string")


def name_modules(modules: list[tuple[int, list[str]]], generate: Generate = from_words) -> dict[int, str]:
    """Names of modules one after another, each prompt with the names given before (sequential by definition)."""
    names: dict[int, str] = {}
    for m, features in modules:
        p = "Name the module. Names in use: " + "; ".join(names.values()) + "\n" + "\n".join(features)
        names[m] = generate([p])[0]
    return names


#: What is asked at each stage of an edit; ``kind`` is the addition of a feature or the change of one.
_ROLE = {"add": "A feature is to be added to a project.", "modify": "A feature of a project is to be changed."}
_STAGES = {
    "need": "Say whether the code below is enough to write the change, or which other files are needed and why. End with a block of JSON: "
    '```json {"needAdditionalFile": true, "additionalFileList": [{"filename": "a.b.C", "recommendReason": "..."}]} ```',
    "plan": "Plan the change: every file to be changed or made, what is to be done there, and what to mind. End with a block of JSON: "
    '```json {"modifiedFileList": [{"filename": "a.b.C", "plan": "...", "note": "..."}]} ```',
    "write": "Write the whole new source of the file below as a block of Java, nothing left out: ```java ... ```",
}


def stage_prompt(kind: str, stage: str, wanted: str, code: str, files: str = "", before: str = "") -> str:
    """The prompt of one stage: the wanted description, for a change the old one, the code known and the list of files or the plan."""
    parts = [_ROLE[kind], _STAGES[stage], f"Wanted:\n{wanted}"]
    if kind == "modify":
        parts.append(f"Until now:\n{before}")
    return "\n\n".join([*parts, f"Code:\n{code}", f"Files:\n{files}"])


def import_prompt(name: str, code: str, files: str) -> str:
    return f"Which import statements does this Java source need? Answer with a block of Java that has nothing but these.\n\nClass: {name}\n\nCode:\n{code}\n\nFiles:\n{files}"


def imports_for(name: str, code: str, files: list[str], generate: Generate) -> list[str]:
    """The import lines a generator gives for a source; an error where the reply has no block of Java."""
    return fenced_block(generate([import_prompt(name, code, "\n".join(files))])[0], "java").splitlines()


def fenced_block(reply: str, language: str) -> str:
    got = re.search(rf"```{language}(.*?)```", reply, re.S)
    if not got:
        raise ValueError(f"no block of {language} in the reply")
    return got.group(1).strip()


def sibling_context(features: DataFrame, code: DataFrame, most: int = 4) -> DataFrame:
    """(module, context): the code of a module's first ``most`` features, in order (the limit is the definition).

    ``features`` (id, module), ``code`` (feature, class_id, code); a class's code comes once, where it comes first."""
    n = features.where("module is not null").select("id", "module").distinct().withColumn("n", F.row_number().over(Window.partitionBy("module").orderBy("id"))).where(F.col("n") <= most)
    one = n.join(code.withColumnRenamed("feature", "id"), "id").groupBy("module", "class_id").agg(F.min(F.struct("n", "code")).alias("x"))
    return one.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.n", "class_id", "x.code"))), lambda x: x["code"]), "\n").alias("context"))


def edit_feature(description: str, classes: dict[str, str], generate: Generate, files: dict[str, str] | None = None, before: str | None = None) -> dict[str, str]:
    """Three stages: which other files are needed, a plan for each file to change, the new source of each. Gives class → source.

    ``classes`` is the code known at first, ``files`` all others; ``before`` is the old description of a feature that is changed."""
    kind, files = ("add" if before is None else "modify"), files or {}
    code = "\n".join(classes.values())
    need = json.loads(fenced_block(generate([stage_prompt(kind, "need", description, code, "\n".join(files), before or "")])[0], "json"))
    more = [f["filename"] for f in need.get("additionalFileList", []) if need.get("needAdditionalFile") and f.get("filename") in files]
    known = classes | {f: files[f] for f in more}
    plan = json.loads(fenced_block(generate([stage_prompt(kind, "plan", description, "\n".join(known.values()), "", before or "")])[0], "json"))
    steps = plan.get("modifiedFileList", []) if isinstance(plan, dict) else plan
    asked = [stage_prompt(kind, "write", description, known.get(p["filename"], files.get(p["filename"], "")), f"{p['filename']}: {p.get('plan', '')} {p.get('note', '')}", before or "") for p in steps]
    return {p["filename"]: fenced_block(text, "java") for p, text in zip(steps, generate(asked))} if steps else {}
