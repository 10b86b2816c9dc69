"""Conversation structure repair by a fold over each conversation's turns.

A repaired conversation's roles read ``(s?(ua)+)?``, by initials.  Its turns are
kept (free), given the role user or assistant (3), deleted (4; blank and
duplicate turns must be) or inserted without text (3); a truncated turn that
stays costs 3 more.  ``aggregate()`` carries four (cost, audit) structs, the
cheapest edits that lead to nothing yet, to a system, a user and an assistant
turn; ``least`` of structs compares costs, then audits.  Two audits of one cost
that read the same turns never begin with each other, as the letters set the
cost, so the least audit of a prefix stays least when letters follow.

No task holds a whole conversation's turns before the end: rows are dealt out by
ranges of (conversation, turn), where a conversation of any length is split, and
folded in segments of at most 256 turns, the first from nothing, a later one
from each of the four states.  A second fold joins the segments.  Only the last
row, which has a conversation's audit and repaired text, is one row by nature.
Faults come from windows of one row at most (first of equal turns, next to it).

Cases: a null role or text counts as one space (so the turn is blank, or its
role must change); null turns come first; rows of one turn are in order of role,
the text's first 64 characters, the text's digest; equal rows are duplicates of
the first; a null conv_id is a conversation; an empty table gives no rows; very
long texts are only trimmed, hashed and joined; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.storage import materialize, table

#: ``FAR`` costs more than any edits: a state that can't be reached.
FAR = 1 << 40
#: Turns of a segment, as a power of two.
SEGMENT_BITS = 8
_SPACE = " \t\n\x0b\x0c\r"
_STATES = "esua"

_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(turns: DataFrame) -> DataFrame:
    """Faults planted by a checksum of ``conv_id:turn``: one row in twenty of each kind.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats
    it, 4 makes it the user's.
    """
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]))
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (kind % 20).alias("_kind"))
    return rows.where("_kind <> 0").select(
        "conv_id",
        "turn",
        F.expr("if(_kind = 4, 'user', role)").alias("role"),
        F.expr("case _kind when 1 then '' when 2 then translate(text, '.!?', '') else text end").alias("text"),
        F.expr("explode(if(_kind = 3, array(0, 1), array(0)))").alias("_copy"),
    ).drop("_copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns with a place that grows with their order, and the faults a turn shows by itself."""
    rows = turns.select(
        "conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.monotonically_increasing_id().alias("tie")
    )
    rows = rows.withColumns({"head": F.left("text", F.lit(64)), "digest": F.unhex(F.sha2("text", 256))})
    order = ["conv_id", "turn", "role", "head", "digest", "tie"]
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "role", "text", "digest",
        F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("").alias("fault"),
        F.monotonically_increasing_id().alias("place"),
    )
    return materialize(placed, "turns")


def _repeats(ordered: DataFrame) -> DataFrame:
    """``conv_id, place`` of turns whose role and text their conversation had before."""
    keys = ["conv_id", "role", "digest"]
    shown = ordered.where("fault <> 'blank'").select(*keys, "place")
    found = shown.groupBy(*keys).agg(F.min("place").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = found.withColumnsRenamed({"conv_id": "_id", "role": "_role", "digest": "_digest"})
    same = F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return shown.join(first, same).where("place > _first").select("conv_id", "place")


def _more(state: str, cost: str, letter: str) -> str:
    return f"named_struct('cost', {state}.cost + {cost}, 'audit', concat({state}.audit, {letter}))"


def _with_inserts(acc: str) -> str:
    """``acc`` and what one or two inserted turns lead to."""
    to_u = ", ".join(_more(f"x.{s}", "3L", "'I'") for s in "esa")
    once = f"transform(array({acc}), x -> named_struct('e', x.e, 's', x.s, 'u', least(x.u, {to_u}), 'a', x.a))"
    return f"transform({once}, x -> named_struct('e', x.e, 's', x.s, 'u', x.u, 'a', least(x.a, {_more('x.u', '3L', "'I'")})))[0]"


def _start(state: str) -> str:
    cells = [f"'{s}', named_struct('cost', {0 if s == state else FAR}L, 'audit', '')" for s in _STATES]
    return _with_inserts(f"named_struct({', '.join(cells)})")


def _fold(state: str) -> str:
    """The four structs after a segment's turns, begun in a state."""
    kept, lost = "if(t.fault = 'truncated', 3L, 0L)", f"t.fault in ('blank', 'duplicate')"

    def cost(role: str) -> str:
        return f"(case when {lost} then {FAR}L when t.initial = '{role}' then {kept} else 3L + {kept} end)"

    def letter(role: str) -> str:
        return f"if(t.initial = '{role}', 'K', 'R')"

    to_s = f"(if({lost} or t.initial <> 's', {FAR}L, {kept}))"
    turn = f"""named_struct(
        'e', {_more("acc.e", "4L", "'D'")},
        's', least({_more("acc.s", "4L", "'D'")}, {_more("acc.e", to_s, "'K'")}),
        'u', least({_more("acc.u", "4L", "'D'")}, {_more("least(acc.e, acc.s, acc.a)", cost("u"), letter("u"))}),
        'a', least({_more("acc.a", "4L", "'D'")}, {_more("acc.u", cost("a"), letter("a"))}))"""
    return f"aggregate(turns, {_start(state)}, (acc, t) -> {_with_inserts(turn)})"


def _segments(ordered: DataFrame) -> DataFrame:
    """Segments of turns with their figures and folds."""
    own = ordered.select("conv_id", "place", F.expr("struct(place, turn, role, text, fault)").alias("own"))
    repeats = _repeats(ordered).select("conv_id", "place", F.col("place").alias("repeat"))
    heads = ordered.groupBy("conv_id").agg(F.min("place").alias("place")).withColumn("head", F.lit(True))
    parts = own.unionByName(repeats, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    gathered = parts.groupBy("conv_id", F.shiftright("place", SEGMENT_BITS).alias("segment")).agg(
        F.array_sort(F.collect_list("own")).alias("own"),
        F.collect_list("repeat").alias("repeats"),
        F.coalesce(F.max("head"), F.lit(False)).alias("head"),
    )
    turns = gathered.withColumn(
        "turns",
        F.expr("""transform(own, t -> struct(t.turn, t.role, t.text, left(t.role, 1) as initial,
                  if(array_contains(repeats, t.place), 'duplicate', t.fault) as fault))"""),
    )
    return turns.select(
        "conv_id",
        F.struct(
            "segment",
            F.expr("array_min(turns.turn)").alias("least"),
            F.expr("array_max(turns.turn)").alias("most"),
            F.expr("size(array_distinct(filter(turns.turn, t -> t is not null)))").cast("long").alias("distinct"),
            *[F.expr(f"size(filter(turns, t -> t.fault = '{f}'))").cast("long").alias(f) for f in ("blank", "duplicate", "truncated")],
            F.expr("""size(filter(transform(turns, (t, i) -> concat(get(turns, i - 1).initial, t.initial)),
                      x -> x not in ('su', 'ua', 'au')))""").cast("long").alias("illegal"),
            F.expr("turns[0].initial").alias("first"),
            F.expr("turns[size(turns) - 1].initial").alias("last"),
            F.expr("transform(turns, t -> struct(t.role, t.text, t.initial))").alias("turns"),
            F.expr(f"if(head, array({_fold('e')}), array({', '.join(map(_fold, _STATES))}))").alias("folds"),
        ).alias("own"),
    )


def _join_folds() -> str:
    """The four structs after all segments, with the states in which segments began."""

    def by_way_of(end: str) -> str:
        ways = [
            f"named_struct('cost', acc.{s}.cost + s.folds[{k}].{end}.cost, 'audit', concat(acc.{s}.audit, s.folds[{k}].{end}.audit), 'path', concat(acc.{s}.path, '{s}'))"
            for k, s in enumerate(_STATES)
        ]
        return f"'{end}', least({', '.join(ways)})"

    first = ", ".join(f"'{s}', named_struct('cost', own[0].folds[0].{s}.cost, 'audit', own[0].folds[0].{s}.audit, 'path', 'e')" for s in _STATES)
    return f"aggregate(slice(own, 2, size(own)), named_struct({first}), (acc, s) -> named_struct({', '.join(map(by_way_of, _STATES))}))"


#: The lines of a segment, from the state in which it begins and the letters of its edits.
_LINES = """
aggregate(regexp_extract_all(audit, '.', 0), named_struct('lines', cast(array() as array<string>), 'at', 0, 'state', state),
    (acc, c) -> named_struct(
        'lines', case c when 'D' then acc.lines
            when 'K' then concat(acc.lines, array(concat(turns[acc.at].role, ':', turns[acc.at].text)))
            else concat(acc.lines, array(concat(if(acc.state = 'u', 'assistant', 'user'), ':', if(c = 'I', '', turns[acc.at].text)))) end,
        'at', acc.at + if(c = 'I', 0, 1),
        'state', case c when 'D' then acc.state when 'K' then turns[acc.at].initial else if(acc.state = 'u', 'a', 'u') end),
    acc -> acc.lines)"""


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id``, faults, ``cost``, ``audit`` and ``repaired`` (``role:text`` lines) of every conversation of ``turns``."""
    whole = _segments(_ordered(turns)).groupBy("conv_id").agg(F.array_sort(F.collect_list("own")).alias("own"))
    ended = whole.withColumn("ends", F.expr(_join_folds())).select(
        "conv_id",
        "own",
        F.expr("least(named_struct('cost', ends.e.cost, 'audit', ends.e.audit, 'path', concat(ends.e.path, 'e')),"
               " named_struct('cost', ends.a.cost, 'audit', ends.a.audit, 'path', concat(ends.a.path, 'a')))").alias("end"),
    )
    # A segment's edits: those of its fold from the state where it begins to the state where the next one does.
    of_end = " ".join(f"when '{s}' then s.folds[instr('{_STATES}', substr(end.path, i + 1, 1)) - 1].{s}.audit" for s in _STATES)
    audit, state = f"(case substr(end.path, i + 2, 1) {of_end} end)", "substr(end.path, i + 1, 1)"
    lines = f"transform(own, (s, i) -> transform(array(named_struct('audit', {audit}, 'state', {state}, 'turns', s.turns)), x -> {_LINES.replace('turns[', 'x.turns[').replace('(audit', '(x.audit').replace("'state', state)", "'state', x.state)")})[0])"

    def total(name: str) -> str:
        return f"aggregate(own, 0L, (n, s) -> n + s.{name})"

    again = "size(filter(transform(own, (s, i) -> get(own, i - 1).most = s.least), x -> x))"
    apart = "size(filter(transform(own, (s, i) -> concat(get(own, i - 1).last, s.first)), x -> x not in ('su', 'ua', 'au')))"
    return ended.select(
        "conv_id",
        F.expr(f"coalesce(array_max(own.most) - array_min(own.least) + 1 - ({total('distinct')} - {again}), 0L)").alias("gaps"),
        *[F.expr(total(n)).alias(n) for n in ("blank", "duplicate", "truncated")],
        F.expr(f"{total('illegal')} + {apart}").alias("illegal"),
        F.expr("end.cost").alias("cost"),
        F.expr("end.audit").alias("audit"),
        F.expr(f"array_join(flatten({lines}), '\n')").alias("repaired"),
    )


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = repair(damage(turns)).withColumnRenamed("conv_id", "_id")
    every = turns.select("conv_id").distinct()
    return every.join(done, every["conv_id"].eqNullSafe(done["_id"]), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _FIGURES],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"),
    )


def _oracle() -> str:
    """DuckDB SQL: the edits turn by turn in a recursive query, with their lines."""

    def more(state: str, cost: str, letter: str, line: str | None) -> str:
        lines = f"{state}.lines" if line is None else f"list_append({state}.lines, {line})"
        return f"case when {state} is not null and {cost} is not null then {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || {letter}, 'lines': {lines}}} end"

    def reach(role: str, name: str, came: str) -> str:
        line = f"case when initial = '{role}' then role else '{name}' end || ':' || text"
        cost, letter = f"(case when fault not in ('blank', 'duplicate') then late + case when initial = '{role}' then 0 else 3 end end)", f"case when initial = '{role}' then 'K' else 'R' end"
        return ", ".join(more(s, cost, letter, line) for s in came)

    def best(*ways: str) -> str:
        return f"least({', '.join(ways)}, null)"

    drop = {s: more(s, "4", "'D'", None) for s in "esua"}
    to_s = more("e", "(case when fault not in ('blank', 'duplicate') and initial = 's' then late end)", "'K'", "role || ':' || text")
    u = best("u", *[more(s, "3", "'I'", "'user:'") for s in "esa"])
    a = best("a", more("u", "3", "'I'", "'assistant:'"))
    return f"""
with recursive given as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
    from conversations
), dealt as (
    select *, xor(4294967295, list_reduce(
        list_concat([4294967295::bigint], list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::bigint)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
            lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end))) % 20 as kind
    from given
), damaged as (
    select conv_id, turn, case kind when 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case kind when 3 then [1, 2] else [1] end) as copy
    from dealt where kind <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, left(text, 64), sha256(text), copy) as n from damaged
), told as (
    select *, left(role, 1) as initial, case
        when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank'
        when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate'
        when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated'
        else '' end as fault
    from placed
), turns as (
    select *, case fault when 'truncated' then 3 else 0 end as late,
        lag(initial) over (partition by conv_id order by n) || initial not in ('su', 'ua', 'au') as apart
    from told
), figures as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (apart) as illegal, max(n) as size
    from turns group by conv_id
), steps as (
    select conv_id, 0::bigint as n, e, s, {u.replace("null)", "null::struct(cost bigint, audit varchar, lines varchar[]))")} as u, a
    from (select conv_id, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} as e,
        null::struct(cost bigint, audit varchar, lines varchar[]) as s, null::struct(cost bigint, audit varchar, lines varchar[]) as u,
        null::struct(cost bigint, audit varchar, lines varchar[]) as a from figures)
    union all
    select conv_id, n, e, s, {u} as u, a from (
        select turns.conv_id, turns.n, {drop["e"]} as e, {best(drop["s"], to_s)} as s,
            {best(drop["u"], reach("u", "user", "esa"))} as u, {best(drop["a"], reach("a", "assistant", "u"))} as a
        from (select conv_id, n, e, s, u, {a} as a from steps) w join turns on turns.conv_id is not distinct from w.conv_id and turns.n = w.n + 1)
), ends as (
    select f.*, least(e, a, null) as w
    from (select conv_id, n, e, {a} as a from steps) d join figures f on f.conv_id is not distinct from d.conv_id and f.size = d.n
)
select g.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(w.cost, 0) as cost, coalesce(w.audit, '') as audit,
    sha256(coalesce(array_to_string(w.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from given) g left join ends on g.conv_id is not distinct from ends.conv_id
"""


QUERIES = {"op11_conversation_repair": _query}
ORACLES = {"op11_conversation_repair": _oracle()}
