"""A set of 1,200 generated rules over events and documents, and SQL that derives the same rules from their numbers.

600 rules read events (equal values, ends, substrings, numbers, lists, negation; with and without a channel and an event
id), 600 read documents (substrings of texts and regular expressions, by language).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.detect import matches, resolver
from tracewell.plans.rules import Rule, rule_of
from tracewell.sources.records import from_documents, from_events

RULES = 600
CHANNELS = ("error", "click", "signup", "purchase", "view")
LANGUAGES = ("de", "en", "es", "fr")
HEADS, VOWELS, TAILS = "bdfghklmnprstw", "aeiou", "nrstl"


def event_detection(i: int) -> dict:
    channel = CHANNELS[i % 5]
    return (
        {"s": {"Channel": channel, "user_id": str(i % 150)}},
        {"s": {"Channel": channel, "EventID": i % 8, "k|lt": i % 100}},
        {"s": {"Channel": list(CHANNELS[: 1 + i % 4]), "owner|endswith": str(i % 100)}},
        {"s": {"Channel": channel, "login|contains": f"-{i % 50}"}, "n": {"EventID": [i % 8, (i + 3) % 8]}, "condition": "s and not n"},
        {"a": {"owner|startswith": f"uSer-{i % 30}", "k": [str(i % 100), str((i + 7) % 100)]}, "b": {"EventID": i % 8, "user_id": str(i % 150)}, "condition": "1 of a* or b"},
        {"s": {"EventID": i % 8, "k|endswith": str(i % 10)}, "n": {"owner|re": f"^User-{i % 15}\\d*$"}, "condition": "s and not n"},
    )[i % 6]


EVENT_SQL = """
  CASE i % 6
  WHEN 0 THEN channel = ch[i % 5 + 1] AND f_user_id = (i % 150)::VARCHAR
  WHEN 1 THEN channel = ch[i % 5 + 1] AND event_id = (i % 8)::VARCHAR AND f_k::INT < i % 100
  WHEN 2 THEN list_contains(ch[1 : 1 + i % 4], channel) AND coalesce(ends_with(f_owner, (i % 100)::VARCHAR), false)
  WHEN 3 THEN channel = ch[i % 5 + 1] AND contains(f_login, '-' || (i % 50)) AND event_id NOT IN ((i % 8)::VARCHAR, ((i + 3) % 8)::VARCHAR)
  WHEN 4 THEN (coalesce(starts_with(f_owner, 'User-' || (i % 30)), false) AND f_k IN ((i % 100)::VARCHAR, ((i + 7) % 100)::VARCHAR))
           OR (event_id = (i % 8)::VARCHAR AND f_user_id = (i % 150)::VARCHAR)
  ELSE event_id = (i % 8)::VARCHAR AND ends_with(f_k, (i % 10)::VARCHAR) AND NOT coalesce(starts_with(f_owner, 'User-' || (i % 15)), false) END"""


def syllable(i: int) -> str:
    return HEADS[i % 14] + VOWELS[i // 14 % 5] + TAILS[i // 70 % 5]


def document_detection(i: int) -> dict:
    word, lang = syllable(i), LANGUAGES[i % 4]
    return (
        {"s": {"Channel": lang, "text|contains": word.title()}},
        {"s": {"Channel": lang, "EventID": i % 4, "text|contains|all": [word, syllable(i + 31)]}},
        {"s": {"text|contains": [word, "no such text"], "EventID": i % 4}, "n": {"text|contains": syllable(i + 77)}, "condition": "s and not n"},
        {"s": {"Channel": lang, "text|re": f"\\b{word}\\w+\\."}} if i % 40 == 3 else {"s": {"Channel": lang, "text|startswith": word[:2]}},
    )[i % 4]


DOCUMENT_SQL = """
  CASE WHEN i % 4 = 0 THEN channel = la[i % 4 + 1] AND contains(lower(f_text), syl(i))
  WHEN i % 4 = 1 THEN channel = la[i % 4 + 1] AND event_id = (i % 4)::VARCHAR AND contains(lower(f_text), syl(i)) AND contains(lower(f_text), syl(i + 31))
  WHEN i % 4 = 2 THEN event_id = (i % 4)::VARCHAR AND contains(lower(f_text), syl(i)) AND NOT contains(lower(f_text), syl(i + 77))
  WHEN i % 40 = 3 THEN channel = la[i % 4 + 1] AND regexp_matches(f_text, '(^|[^\\pL\\pM\\p{Nd}\\p{Pc}])' || syl(i) || '[\\pL\\pM\\p{Nd}\\p{Pc}]+\\.')
  ELSE channel = la[i % 4 + 1] AND starts_with(lower(f_text), syl(i)[1:2]) END"""
_SYLLABLE = f"'{HEADS}'[{{0}} % 14 + 1] || '{VOWELS}'[{{0}} // 14 % 5 + 1] || '{TAILS}'[{{0}} // 70 % 5 + 1]"


def rules(kind: str, n: int = RULES) -> list[Rule]:
    make = event_detection if kind == "events" else document_detection
    head = {"author": "a", "level": "low", "status": "test", "date": "2024-01-01", "logsource": {}}
    return [rule_of("generated", head | {"title": f"{kind} {i}", "id": f"{kind}-{i}", "detection": make(i)}) for i in range(n)]


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id and rule_id of every detection."""
    def found(records: DataFrame, kind: str) -> DataFrame:
        return matches(records, rules(kind), resolver(records)).select("record_id", F.concat(F.lit(f"{kind}-"), "rule_no").alias("rule_id"))

    return found(from_events(spark, sf_dir), "events").unionByName(found(from_documents(spark, sf_dir), "documents"))


def many_rules_sql(events: str, documents: str) -> str:
    spelled = DOCUMENT_SQL
    for at in ("i + 31", "i + 77", "i"):
        spelled = spelled.replace(f"syl({at})", f"({_SYLLABLE.format(f'({at})')})")
    lists = f"{list(CHANNELS)} AS ch, {list(LANGUAGES)} AS la"
    return f"""SELECT record_id, 'events-' || i AS rule_id FROM (WITH {events} SELECT * FROM rec), (SELECT range AS i, {lists} FROM range({RULES})) WHERE {EVENT_SQL}
UNION ALL SELECT record_id, 'documents-' || i FROM (WITH {documents} SELECT * FROM rec), (SELECT range AS i, {lists} FROM range({RULES})) WHERE {spelled}"""
