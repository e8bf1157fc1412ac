"""Substring dedup: words of passages that occur more than once.

Seed and extend: winnowing picks anchors (short word runs) so that every window has one; texts meet on equal anchors,
which extend both ways as far as any window around them reaches, first whole contexts at once and then, where contexts
differ, window by window. What the repeated windows cover, joined up, are the maximal repeats of at least the
threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm import common as c
from foliant.llm import repeats
from foliant.llm.words import find_words

SCHEMA = "row long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeated(docs: DataFrame, window: int = 35, anchor: int = 7, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each text without the words covered by a window of consecutive words that also starts anywhere else.

    Words are runs free of the six ASCII white-space characters. Windows are judged on the input. Equal rows count as
    places of their own, so their windows repeat; ids may be null or repeat. A null or empty text has no words. An
    empty table gives an empty result. Columns named in carry are passed on, others are ignored. kept: the kept words joined by one space, null
    unless keep_text; a text that lost nothing keeps its white space there (kept_sha256 is of the joined words).
    """
    if not 1 <= anchor <= window:
        raise ValueError("anchor must be from 1 to window")

    def finish(batch, covered: np.ndarray, ranges: np.ndarray) -> pa.Table:
        data, offs = c.flat(batch.column("text"))
        starts, ends, _ = find_words(data, offs)
        before = np.concatenate([[0], np.cumsum(covered)])
        removed = before[ranges[1:]] - before[ranges[:-1]]
        # all kept words, each with one space after it
        keep = ~covered
        size = np.where(keep, ends - starts + 1, 0)
        out_at = np.concatenate([[0], np.cumsum(size)])
        joined = np.full(out_at[-1], 32, np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[keep]] += 1
        inside[ends[keep]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        spaces = np.zeros(len(joined), bool)
        spaces[out_at[1:][keep] - 1] = True
        joined[~spaces] = data[inside]
        kept, digests = [], []
        for i in range(len(ranges) - 1):
            text = joined[out_at[ranges[i]] : max(out_at[ranges[i]], out_at[ranges[i + 1]] - 1)].tobytes()
            digests.append(hashlib.sha256(text).hexdigest())
            if keep_text:
                kept.append((text if removed[i] else data[offs[i] : offs[i + 1]].tobytes()).decode("utf-8", "replace"))
            else:
                kept.append(None)
        columns = [pa.array(c.longs(batch.column("row"))), pa.array(batch.column("doc_id").to_pylist(), pa.int64()), pa.array(np.diff(ranges), pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
        columns += [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (batch.column(k) for k in carry)]
        return pa.Table.from_arrays(columns, ["row", "doc_id", "n_words", "n_removed", "kept_sha256", "kept", *carry])

    seeds, length = repeats.winnowed_seeds(window, anchor)
    keyed = c.keyed(docs, id_col, text_col, carry)
    schema = ", ".join([SCHEMA, *(f"{k} {keyed.schema[k].dataType.simpleString()}" for k in carry)])
    return repeats.repeated_runs(keyed, repeats.word_tokens, window, seeds, length, False, finish, schema)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d)),
hit as (select doc_id, i from win where s in (select s from win group by s having count(*) > 1)),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as j from hit),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as j from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by j) as t from words where (doc_id, j) not in (select (doc_id, j) from gone) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""
