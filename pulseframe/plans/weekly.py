"""Weekly plans as JSON files: checked, completed and written whole."""

from __future__ import annotations

import datetime
import json
import os
import uuid

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def faults(plan) -> list[str]:
    """Everything that is wrong with a plan."""
    if not isinstance(plan, dict):
        return ["a plan is a JSON object"]
    found = []
    version, monday, planned, name = (plan.get(k) for k in ("schema_version", "week_of", "planned", "plan_id"))
    if not isinstance(version, int) or isinstance(version, bool):
        found.append("schema_version is a whole number")
    try:
        if not isinstance(monday, str) or datetime.date.fromisoformat(monday).isoformat() != monday:
            raise ValueError
    except ValueError:
        found.append("week_of is a date, YYYY-MM-DD")
    if name is not None:
        try:
            uuid.UUID(str(name))
        except ValueError:
            found.append("plan_id is a UUID")
    if not isinstance(planned, list) or not planned:
        return [*found, "planned is a list that isn't empty"]
    seen: set[str] = set()
    for at, item in enumerate(planned):
        if not isinstance(item, dict):
            found.append(f"planned[{at}] is an object")
            continue
        own = item.get("id")
        if not isinstance(own, str) or not own.strip() or own in seen:
            found.append(f"planned[{at}].id is a text of its own")
        else:
            seen.add(own)
        if not isinstance(item.get("constraints"), dict):
            found.append(f"planned[{at}].constraints is an object")
        if item.get("day") is not None and item["day"] not in DAYS:
            found.append(f"planned[{at}].day is a weekday")
    return found


def complete(plan: dict) -> dict:
    """The plan with plan_id and generated_at; ValueError with all faults."""
    if wrong := faults(plan):
        raise ValueError("; ".join(wrong))
    now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return plan | {"plan_id": str(uuid.UUID(str(plan.get("plan_id") or uuid.uuid4()))), "generated_at": plan.get("generated_at") or now}


def write_whole(path: str, text: str) -> None:
    """Replaces the file at once, so nobody reads half of it."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    draft = f"{path}.{os.getpid()}.{uuid.uuid4().hex}"
    try:
        with open(draft, "w", encoding="utf-8") as file:
            file.write(text)
        os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.remove(draft)


def save(plan: dict, path: str) -> dict:
    whole = complete(plan)
    write_whole(path, json.dumps(whole, ensure_ascii=False, indent=2) + "\n")
    return whole


def load(path: str) -> dict | None:
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None
