"""Small files of the driver: the registry of sources and profiles, progress, and atomic replacement."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from vacantia.sources.feeds import adapters

SOURCE = "source_id string, company string, adapter string, identifier string, enabled boolean, region string"
PROGRESS_KEYS = ("stage", "status", "total", "completed", "succeeded", "failed", "started_at", "finished_at")


def load(own: str | Path, example: str | Path) -> dict:
    """The JSON object of our own file if there is one, else of the example; a missing or unreadable file raises."""
    path = Path(own) if Path(own).exists() else Path(example)
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise ValueError(f"{path} is missing") from None
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON: {e}") from None
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def sources(spark: SparkSession, registry: dict) -> DataFrame:
    """The sources of a registry; blank or repeated ids and unknown adapters raise."""
    rows, seen = [], set()
    for s in registry.get("sources", []):
        key = str(s.get("id") or "").strip()
        if not key or key.casefold() in seen:
            raise ValueError(f"source id {key!r} is blank or repeated")
        if s.get("adapter") not in adapters():
            raise ValueError(f"source {key} has the unknown adapter {s.get('adapter')!r}")
        seen.add(key.casefold())
        rows.append((key, s.get("company"), s["adapter"], s.get("identifier"), bool(s.get("enabled", False)), s.get("region")))
    return spark.createDataFrame(rows, SOURCE)


def read_progress(path: str | Path, keys: tuple[str, ...] = PROGRESS_KEYS) -> dict:
    """The allowed fields of a progress file that hold text, numbers or nothing; empty where it can't be read."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return {k: v for k, v in found.items() if k in keys and (v is None or isinstance(v, (str, int, float)))} if isinstance(found, dict) else {}


def replace_json(path: str | Path, value: object) -> None:
    """Writes a JSON file as a whole: readers see the old or the new one, never a part."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def demo_messages(spark: SparkSession) -> DataFrame:
    """Five invented messages in the forms of the parsers, to try the whole pipeline on."""
    rows = [
        ("telegram", "demo_channel", "1", "2025-01-06T08:00:00+00:00", "Demo", "Data Engineer @ Orlin Systems\nPosted on: 06-01-2025\nLocation: Port Alma", ["https://jobs.orlin.example/1"]),
        ("telegram", "demo_channel", "2", "2025-01-06T09:00:00+00:00", "Demo", "QA Engineer @ Vask Energy\nPosted on: 05-01-2025\nLocation: Remote", ["https://jobs.vask.example/2"]),
        ("telegram", "demo_channel", "3", "2025-01-07T08:00:00+00:00", "Demo", "Data Engineer @ Orlin Systems\nPosted on: 06-01-2025\nLocation: Port Alma", ["https://jobs.orlin.example/1?ref=chat"]),
        ("whatsapp", "demo group", "wa_1", "2025-01-07T10:00:00", "Ann", "*Backend Developer*\n📈 Level: Mid\nPosted today", ["https://jobs.orlin.example/4"]),
        ("whatsapp", "demo group", "wa_2", "2025-01-07T11:00:00", "Ann", "See you at the meet-up", []),
    ]
    return spark.createDataFrame([(*r, None) for r in rows], "source string, source_group string, source_message_id string, message_date string, sender string, raw_text string, urls array<string>, source_message_url string")
