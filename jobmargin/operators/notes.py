"""Search in field notes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmargin.functions.text import contains_pattern, tokens
from jobmargin.operators.portfolio import for_project
from jobmargin.sources import note_index

Tables = Mapping[str, DataFrame]

RECENT_LIMIT = 100


def _with_project_name(tables: Tables, notes: DataFrame) -> DataFrame:
    return notes.join(tables["contracts"].select("project_id", "project_name"), "project_id")


def field_notes_search(tables: Tables, project_id: str | None = None, search: str | None = None,
                       note_type: str | None = None) -> DataFrame:
    """Notes matching all given filters, newest first; without any filter the most recent ones.

    Empty filters count as not given.  The filters run before the join, in the scan's stage.
    """
    if not (project_id or search or note_type):
        return field_notes_recent(tables)
    notes = for_project(tables["field_notes"], project_id or None)
    if search:
        notes = notes.where(contains_pattern("content", search))
    if note_type:
        notes = notes.where(F.col("note_type") == note_type)
    return _with_project_name(tables, notes).orderBy(F.desc("date"), "note_id")


def field_notes_recent(tables: Tables, limit: int = RECENT_LIMIT) -> DataFrame:
    """The newest notes of known projects: a distributed top-k, ties by note_id.

    The top-k runs on keys and dates; texts are only read for the chosen notes, whose
    number is the limit, and are never shuffled to be sorted out.
    """
    keys = tables["field_notes"].select("note_id", "project_id", "date")
    chosen = (
        _with_project_name(tables, keys)
        .orderBy(F.desc("date"), "note_id")
        .limit(limit)
        .select("note_id", "project_name")
    )
    return tables["field_notes"].join(chosen, "note_id").orderBy(F.desc("date"), "note_id")


def field_note_tokens(tables: Tables) -> DataFrame:
    """(note_id, token): the distinct lower-case words of every note.

    Written out clustered by token this is the search index of the notes.
    """
    return tables["field_notes"].select("note_id", F.explode(tokens("content")).alias("token"))


def field_notes_token_search(tables: Tables, words: Iterable[str], index: str | None = None) -> DataFrame:
    """Notes that contain every given word as a whole token; no stemming.

    With an index (`sources.note_index`) only its posting lists of the words and the notes found are
    read.  Without one, every note's own token array is searched; nothing is exploded or
    shuffled before the filter.
    """
    wanted = sorted({w.lower() for w in words})
    if not wanted:
        raise ValueError("Give at least one word.")
    if index:
        notes = note_index.search(tables["contracts"].sparkSession, index, wanted)
    else:
        found = F.array_intersect(tokens("content"), F.array(*[F.lit(w) for w in wanted]))
        notes = tables["field_notes"].where(F.size(found) == len(wanted))
    return _with_project_name(tables, notes).orderBy(F.desc("date"), "note_id")
