"""Queries of the models, lookups and counts. Vocabularies are derived from the documents by
one rule, in Spark and in SQL alike: the commonest words by (count, word), and characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tokenloom.artifacts import piece_model as pm
from tokenloom.artifacts.registry import MODELS, PREFIXES, resolve
from tokenloom.functions import normalizers as N
from tokenloom.kernels.alphabet import BYTE_TO_CHAR, to_alphabet
from tokenloom.kernels.bpe import AddedTokens, Bpe
from tokenloom.kernels.byte_rank import ByteRank
from tokenloom.kernels.charsmap import build_charsmap
from tokenloom.kernels.piece_models import PieceMerges, Unigram
from tokenloom.kernels.tokens import WordTokens as _Tokens
from tokenloom.kernels.wordpiece import WordPiece
from tokenloom.operators import decode as D
from tokenloom.operators import encode as E
from tokenloom.operators.words import count_words
from tokenloom.plans.decoding import _cleaned as cleaned
from tokenloom.plans.text import _RE2_PUNCT, _WS, MARK, _extract, gpt2_segments_sql
from tokenloom.session import ship
from tokenloom.sources.tables import dealt, table
from tokenloom.spec import AddedToken, BpeOptions, EncodeOptions, TokenizerSpec, TruncationMode

TOP, PIECES, CHAINS = 300, 300, 200
SPECIALS = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _texts(spark, sf_dir, *columns):
    """Documents for work on each text."""
    return dealt(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def words(spark, sf_dir):
    """Every word of a-z with its count."""
    return count_words(_texts(spark, sf_dir, "text").select(F.lower("text").alias("text")), "[a-z]+")


def _top(spark, sf_dir, low: int, high: int, n: int) -> list[str]:
    """The n commonest words of these lengths."""
    return [r["w"] for r in words(spark, sf_dir).where(F.length("w").between(low, high)).orderBy(F.desc("n"), "w").limit(n).collect()]


def wordpiece_spec(spark, sf_dir) -> TokenizerSpec:
    # one pass: the letters, 26 at most, are seen while the top is sought
    seen, letters = Observation(), "abcdefghijklmnopqrstuvwxyz"
    counted = words(spark, sf_dir).observe(seen, *(F.max(F.col("w").contains(c)).alias(c) for c in letters))
    top = [r.w for r in counted.orderBy(F.desc("n"), "w").limit(TOP).collect()]
    chars = [c for c in letters if seen.get[c]]
    rows = {(1, w) for w in top if len(w) > 1} | {(2, c) for c in chars} | {(3, f"##{c}") for c in chars} | {(4, f"##{w}") for w in top if 2 <= len(w) <= 4}
    vocab = SPECIALS | {t: i + 4 for i, (_, t) in enumerate(sorted(rows))}
    return TokenizerSpec("WordPiece", WordPiece(vocab), special_ids=SPECIALS)


def merge_rules(spark, sf_dir) -> list[tuple[str, str]]:
    top = _top(spark, sf_dir, 2, 12, CHAINS)
    return [(a, b) for _, a, b in sorted({(k, w[:k], w[k : k + 1]) for w in top for k in range(1, len(w))})]


def _per_word(kernel):
    """w and the pieces of every distinct word; ``kernel`` makes the model on the driver."""

    def run(spark, sf_dir):
        shared = E.broadcast_model(spark, kernel(spark, sf_dir))

        @F.pandas_udf("string")
        def cut(s: pd.Series) -> pd.Series:
            return s.map(lambda w: " ".join(shared.value(w)))

        return words(spark, sf_dir).select("w", cut("w").alias("pieces"))

    return run


def _bpe(spark, sf_dir):
    rules = merge_rules(spark, sf_dir)
    tokens = sorted({a + b for a, b in rules} | set("abcdefghijklmnopqrstuvwxyz"))
    return _Tokens(Bpe({t: i for i, t in enumerate(tokens)}, rules, BpeOptions()), "encode")


def _byte_rank(spark, sf_dir):
    ranks = {bytes([b]): b for b in range(256)}
    for a, b in merge_rules(spark, sf_dir):
        ranks.setdefault((a + b).encode(), len(ranks))
    return _Tokens(ByteRank(ranks, "[a-z]+", {}), "encode")


def _unigram(spark, sf_dir):
    top = _top(spark, sf_dir, 1, 8, PIECES)
    pieces = [pm.Piece(0, "<unk>", 0.0, pm.UNKNOWN)] + [pm.Piece(i + 1, w, -1.0 * (i + 1), pm.NORMAL) for i, w in enumerate(top)]
    return _Tokens(Unigram(pm.PieceModel(tuple(pieces))), "path")


def piece_vocabulary(spark, sf_dir) -> list[str]:
    """Characters, then the commonest words and all their beginnings, each by (length, text)."""
    top = _top(spark, sf_dir, 2, 8, PIECES)
    grown = {f"▁{w[:k]}" for w in top for k in range(1, len(w) + 1)} | {w[:k] for w in top for k in range(2, len(w) + 1)}
    return sorted({"▁", *"abcdefghijklmnopqrstuvwxyz"} | grown, key=lambda t: (len(t), t))


def _piece_merges(spark, sf_dir):
    pieces = [pm.Piece(i, t, 0.0, pm.NORMAL) for i, t in enumerate(piece_vocabulary(spark, sf_dir))]
    return _Tokens(PieceMerges(pm.PieceModel(tuple(pieces), pm.BPE)), "encode")


def sp_bpe_merges(spark, sf_dir):
    """Merge rules as a relation: every split of a piece whose two parts are pieces."""
    vocab = spark.createDataFrame(list(enumerate(piece_vocabulary(spark, sf_dir))), "id int, piece string")
    cuts = vocab.where(F.length("piece") > 1).select("id", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - 1)).alias("k"))
    parts = cuts.select("id", "k", "piece", F.substring("piece", F.lit(1), F.col("k")).alias("l"), F.substring(F.col("piece"), F.col("k") + 1, F.length("piece")).alias("r"))
    known = F.broadcast(vocab.select(F.col("piece").alias("l")))
    return parts.join(known, "l", "left_semi").join(F.broadcast(vocab.select(F.col("piece").alias("r"))), "r", "left_semi").select("id", "k", "l", "r")


def _ids(column: str):
    """The ids as text; casts of a whole array run compiled, a lambda is interpreted element by element."""
    return F.array_join(F.col(column).cast("array<string>"), " ")


def _spots(column: str):
    """start:end of each token, out of the text form of all: [{0, 3}, {3, 4}]."""
    shown = F.replace(F.replace(F.col(column).cast("string"), F.lit("}, {"), F.lit(" ")), F.lit(", "), F.lit(":"))
    return F.substring(shown, F.lit(3), F.greatest(F.length(shown) - 4, F.lit(0)))


def wordpiece_encode(spark, sf_dir):
    out = E.encode_to_ids(_texts(spark, sf_dir), wordpiece_spec(spark, sf_dir))
    return out.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(_ids("ids")).alias("ids_md5"))


def encode_max_tokens(spark, sf_dir):
    out = E.encode_to_ids(_texts(spark, sf_dir), wordpiece_spec(spark, sf_dir), options=EncodeOptions(add_special_tokens=False), limit=8)
    return out.select("doc_id", _ids("ids").alias("ids"))


def encode_to_ids(spark, sf_dir):
    out = E.encode_to_ids(_texts(spark, sf_dir), wordpiece_spec(spark, sf_dir), options=EncodeOptions(max_length=8, truncation=TruncationMode.LONGEST_FIRST))
    return out.select("doc_id", _ids("ids").alias("ids"))


def encode_to_ids_whole(spark, sf_dir):
    """All ids of every document."""
    out = E.encode_to_ids(_texts(spark, sf_dir), wordpiece_spec(spark, sf_dir))
    return out.select("doc_id", _ids("ids").alias("ids"))


def count_tokens(spark, sf_dir):
    out = E.count_tokens(_texts(spark, sf_dir), wordpiece_spec(spark, sf_dir))
    return out.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


def count_tokens_by_group(spark, sf_dir):
    out = E.count_tokens(_texts(spark, sf_dir, "lang", "text"), wordpiece_spec(spark, sf_dir))
    return out.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens").cast("long")).alias("tokens"))


def encode_pair(spark, sf_dir):
    """Every user turn with the answer to it, where one follows."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", "text")
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    out = E.encode_fields(asked.join(said, ["conv_id", "turn"]), wordpiece_spec(spark, sf_dir), ["ids", "type_ids"], pair="answer")
    return out.select("conv_id", "turn", F.size("ids").cast("long").alias("n"), F.md5(_ids("ids")).alias("ids_md5"), F.md5(_ids("type_ids")).alias("types_md5"))


def tokens_relation(spark, sf_dir):
    out = E.encode_fields(_texts(spark, sf_dir), wordpiece_spec(spark, sf_dir), ["ids", "tokens", "offsets"])
    return E.tokens_relation(out, None, keys=["doc_id"])


def decode_ids_wordpiece(spark, sf_dir):
    spec = wordpiece_spec(spark, sf_dir)
    out = E.encode_to_ids(_texts(spark, sf_dir), spec)  # both in one worker: nothing stands between them
    return D.decode(out, spec, skip_special_tokens=True).select("doc_id", F.col("decoded").alias("value"))


def _common(spark, sf_dir) -> list[str]:
    """The commonest words of any letters, by (count, word)."""
    found = count_words(_texts(spark, sf_dir, "text"), r"\p{L}+")
    return [r["w"] for r in found.where("length(w) between 2 and 12").orderBy(F.desc("n"), "w").limit(TOP).collect()]


def _chains(words: list) -> list[tuple]:
    """Merges that build each word from its first symbol on, the short ones first."""
    return [(a, b) for _, a, b in sorted({(k, w[:k], w[k : k + 1]) for w in words for k in range(1, len(w))})]


def bpe_spec(spark, sf_dir) -> TokenizerSpec:
    """Byte-level, with two added tokens."""
    rules = _chains([to_alphabet((s + w).encode()) for w in _common(spark, sf_dir) for s in ("", " ")])
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*BYTE_TO_CHAR.values(), *(a + b for a, b in rules)]))}
    added = (AddedToken(len(vocab), "<|endoftext|>", normalized=False, special=True), AddedToken(len(vocab) + 1, "##"))
    return TokenizerSpec("Bpe", Bpe(vocab, rules, BpeOptions(byte_level=True)), added_tokens=added)


def tiktoken_spec(spark, sf_dir) -> TokenizerSpec:
    """The pattern and specials of cl100k_base."""
    ranks = {bytes([b]): b for b in range(256)}
    for a, b in _chains([(s + w).encode() for w in _common(spark, sf_dir) for s in ("", " ")]):
        ranks.setdefault(a + b, len(ranks))
    _, pattern, specials = resolve("cl100k_base")
    return TokenizerSpec("Tiktoken", ByteRank(ranks, pattern, specials))


_CONTROLS = [("<unk>", pm.UNKNOWN), ("<s>", pm.CONTROL), ("</s>", pm.CONTROL)]
_MAPPED = {"\n": " ", "\t": " ", "\u00a0": " ", "“": '"', "”": '"', "’": "'", "…": "..."}


def unigram_spec(spark, sf_dir) -> TokenizerSpec:
    """With a character map, extra white space removed, and a space put before."""
    top = _common(spark, sf_dir)
    rows = [(f"▁{w}", -8 - i / 64) for i, w in enumerate(top)] + [(w, -9 - i / 64) for i, w in enumerate(top)]
    rows += [(c, -14 - i / 64) for i, c in enumerate(["▁", *sorted({*"".join(top), *".,"})])]
    pieces = [pm.Piece(i, t, 0.0, k) for i, (t, k) in enumerate(_CONTROLS)] + [pm.Piece(i + 3, t, x, pm.NORMAL) for i, (t, x) in enumerate(rows)]
    return TokenizerSpec("SentencePieceUnigram", Unigram(pm.PieceModel(tuple(pieces), charsmap=build_charsmap(_MAPPED))))


def sp_bpe_spec(spark, sf_dir) -> TokenizerSpec:
    """Characters, then the commonest words and all their beginnings, each by (length, text)."""
    top = _common(spark, sf_dir)
    grown = {f"▁{w[:k]}" for w in top for k in range(1, len(w) + 1)} | {w[:k] for w in top for k in range(2, len(w) + 1)}
    texts = sorted({"▁", *".,", *"".join(top)} | grown, key=lambda t: (len(t), t))
    pieces = [pm.Piece(i, t, 0.0, k) for i, (t, k) in enumerate([*_CONTROLS, *((t, pm.NORMAL) for t in texts)])]
    return TokenizerSpec("SentencePieceBpe", PieceMerges(pm.PieceModel(tuple(pieces), pm.BPE)))


def _whole_texts(spec):
    """Whole documents by this tokenizer: how many tokens, and digests of all ids, tokens and offsets."""

    def run(spark, sf_dir):
        out = E.encode_fields(_texts(spark, sf_dir), spec(spark, sf_dir), ["ids", "tokens", "offsets"])
        return out.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(_ids("ids")).alias("ids_md5"), F.md5(F.array_join("tokens", MARK)).alias("tokens_md5"), F.md5(_spots("offsets")).alias("offsets_md5"))

    return run


def _decoded(spec):
    """Whole documents encoded and decoded again by this tokenizer."""

    def run(spark, sf_dir):
        made = spec(spark, sf_dir)
        out = E.encode_to_ids(_texts(spark, sf_dir), made)
        return D.decode(out, made, skip_special_tokens=True).select("doc_id", F.col("decoded").alias("value"))

    return run


def sp_offsets(spark, sf_dir):
    """Where the pieces of whole documents stand in the original text: one row a token."""
    return E.encode_to_rows(_texts(spark, sf_dir), unigram_spec(spark, sf_dir), keys=["doc_id"]).select("doc_id", "pos", "token", "start", "end")


def token_to_id(spark, sf_dir):
    vocab = D.vocabulary(spark, wordpiece_spec(spark, sf_dir).model.vocab)
    return D.token_to_id(words(spark, sf_dir).select(F.col("w").alias("token")), vocab).select("token", "id")


def id_to_token(spark, sf_dir):
    vocab = D.vocabulary(spark, wordpiece_spec(spark, sf_dir).model.vocab)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("int").alias("id"))
    return D.id_to_token(parts, vocab).select("id", "token")


def id_offset(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_partkey").cast("long").alias("i"))
    return parts.select("p_partkey", D.to_external(F.col("i")).alias("external"), D.to_internal(D.to_external(F.col("i"))).alias("internal"))


def bpe_segments(spark, sf_dir):
    """The kernel's own segmentation of byte-level models, over all documents."""
    ship(spark)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        model = Bpe({}, [], BpeOptions(byte_level=True))
        return s.map(lambda t: [x for x, _, _ in model.segments(t)], na_action="ignore")

    rows = _texts(spark, sf_dir).select("doc_id", cut("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", MARK).alias("segments"))


ADDED = (AddedToken(0, "the"), AddedToken(1, "then"), AddedToken(2, "##", special=True))


def added_token_split(spark, sf_dir):
    ship(spark)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        finder = AddedTokens(ADDED)

        def parts(t: str) -> list[str]:
            out, at = [], 0
            for _, a, b in [*finder.find(t), (None, len(t), len(t))]:
                out += [x for x in (t[at:a], t[a:b]) if x]
                at = b
            return out

        return s.map(parts, na_action="ignore")

    rows = _texts(spark, sf_dir).select("doc_id", cut("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", MARK).alias("segments"))


def sp_normalize_unigram(spark, sf_dir):
    space = N.replace(rf"[{N.SPACE_CLASS}]+", " ", regex=True)
    made = N.sequence([space, lambda c: F.trim(c), N.prepend(" "), N.replace(" ", "▁")])
    return _texts(spark, sf_dir).select("doc_id", made(F.col("text")).alias("value"))


def tiktoken_registry(spark, sf_dir):
    return spark.createDataFrame([*MODELS.items(), *PREFIXES], "name string, encoding string")


_FREQ = "freq as materialized (select w, count(*) n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) w from documents) group by w)"
_TOP = lambda low, high, n: f"(select w, n from freq where length(w) between {low} and {high} order by n desc, w limit {n})"
_VOCAB = f"""{_FREQ}, top as {_TOP(1, 1 << 30, TOP)},
ch as (select distinct c from (select unnest(string_split(w, '')) c from freq) where c <> ''),
vocab as materialized (select '[PAD]' tok, 0 id union all select '[UNK]', 1 union all select '[CLS]', 2 union all select '[SEP]', 3 union all
  select tok, row_number() over (order by g, tok) + 3 from (select w tok, 1 g from top where length(w) > 1 union all select c, 2 from ch
  union all select '##' || c, 3 from ch union all select '##' || w, 4 from top where length(w) between 2 and 4) group by tok, g)"""
#: Greedy matching of the distinct segments ``seg(w)``.
_GREEDY = """r as (select w, 1 p, 0 i, null::varchar tok from seg where length(w) <= 100
  union all select r.w, r.p + m.l, r.i + 1, m.tok from r, lateral (select k l, v.tok from range(1, least(length(r.w) - r.p + 1, 40) + 1) t(k)
    join vocab v on v.tok = (case when r.p > 1 then '##' else '' end) || substr(r.w, r.p, k) order by k desc limit 1) m where r.p <= length(r.w)),
good as (select w from r group by w having max(p) = any_value(length(w)) + 1),
wp as (select r.w, list(r.tok order by r.i) toks, list(v.id order by r.i) ids from r join vocab v on v.tok = r.tok where r.tok is not null and r.w in (select w from good) group by r.w
  union all select w, ['[UNK]'], [1] from seg where w not in (select w from good))"""


def _encoded_sql(select: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """``enc``: key, ids (without specials) of every row."""
    cut = _extract(f"lower({text})", rf"[{_RE2_PUNCT}]|[^{_WS}{_RE2_PUNCT}]+")
    return f"""with recursive {_VOCAB}, parts as (select {key}, unnest(s) w, generate_subscripts(s, 1) pos from (select {key}, {cut} s from {table})),
seg as (select distinct w from parts), {_GREEDY},
enc as (select t.{key}, coalesce(flatten(list(wp.ids order by p.pos) filter (wp.ids is not null)), []) ids from {table} t left join parts p using ({key}) left join wp on wp.w = p.w group by t.{key})
{select}"""


_TEXT = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda v: v::varchar), ' '), '')"
_WITH = "flatten([[2], ids, [3]])"
_PAIRS = f"pairs as (select k l_r, l, r, row_number() over (order by k, l, r) - 1 rk from (select distinct k, substr(w, 1, k) l, substr(w, k + 1, 1) r from {_TOP(2, 12, CHAINS)} t, lateral (select unnest(range(1, length(w))) k)))"
_MERGED = lambda rules, start, on: f"""b as (select w, string_split({start}, '') s, 0 step from freq
  union all select b.w, list_concat(list_concat(b.s[1:m.i - 1], [b.s[m.i] || b.s[m.i + 1]]), b.s[m.i + 2:]), b.step + 1
  from b, lateral (select i, rk from range(1, len(b.s)) t(i) join {rules} mm on {on} order by rk, i limit 1) m),
fin as (select w, arg_max(s, step) s from b group by w) select w, array_to_string(s, ' ') pieces from fin"""  # noqa: E731
_PIECE_VOCAB = f"""{_FREQ}, top as {_TOP(2, 8, PIECES)}, cuts as (select w, unnest(range(1, length(w) + 1)) k from top),
piece as (select tok, row_number() over (order by length(tok), tok) - 1 id from (select '▁' tok union select unnest(string_split('abcdefghijklmnopqrstuvwxyz', ''))
  union select '▁' || substr(w, 1, k) from cuts union select substr(w, 1, k) from cuts where k > 1) where tok <> ''),
rules as (select p.id, k, substr(p.tok, 1, k) l, substr(p.tok, k + 1) r from piece p, lateral (select unnest(range(1, length(p.tok))) k)
  where substr(p.tok, 1, k) in (select tok from piece) and substr(p.tok, k + 1) in (select tok from piece))"""
_VITERBI = f"""with recursive {_FREQ}, pieces as (select w tok, (-1.0 * (row_number() over (order by n desc, w)))::real sc from {_TOP(1, 8, PIECES)}),
pen as (select (min(sc) - 10)::real u from pieces),
v as (select w, 0 pos, [0.0::real] best, [null::varchar] pc, [0::bigint] prev from freq
  union all select v.w, v.pos + 1, list_append(v.best, m.sc), list_append(v.pc, m.tok), list_append(v.prev, m.p)
  from v, lateral (select sc, tok, p from (
      select (v.best[v.pos + 1 - k + 1] + q.sc)::real sc, q.tok, v.pos + 1 - k p, 0 unk from range(1, least(v.pos + 1, 8) + 1) t(k) join pieces q on q.tok = substr(v.w, v.pos + 1 - k + 1, k)
      union all select (v.best[v.pos + 1] + (select u from pen))::real, '<unk>', v.pos, 1) order by sc desc, p, unk limit 1) m where v.pos < length(v.w)),
bt as (select w, pos::bigint pos, prev, pc, []::varchar[] o from v where pos = length(w)
  union all select w, prev[pos + 1], prev, pc, list_prepend(pc[pos + 1], o) from bt where pos > 0)
select w, array_to_string(o, ' ') pieces from bt where pos = 0"""
_SEGMENTS = lambda list_: f"select doc_id, len(s)::bigint n, coalesce(array_to_string(s, '{MARK}'), '') segments from (select doc_id, {list_} s from documents)"

QUERIES = {
    "wordpiece_word_pieces": _per_word(lambda s, d: _Tokens(wordpiece_spec(s, d).model, "word")),
    "wordpiece_encode": wordpiece_encode,
    "encode_max_tokens": encode_max_tokens,
    "encode_to_ids": encode_to_ids,
    "encode_to_ids_whole": encode_to_ids_whole,
    "count_tokens": count_tokens,
    "count_tokens_by_group": count_tokens_by_group,
    "encode_pair": encode_pair,
    "tokens_relation": tokens_relation,
    "decode_ids_wordpiece": decode_ids_wordpiece,
    "decode_ids_bpe": _decoded(bpe_spec),
    "decode_ids_tiktoken": _decoded(tiktoken_spec),
    "decode_ids_sentencepiece": _decoded(unigram_spec),
    "decode_ids_sp_bpe": _decoded(sp_bpe_spec),
    "sp_offsets": sp_offsets,
    "bpe_encode": _per_word(_bpe),
    "bpe_encode_text": _whole_texts(bpe_spec),
    "bpe_segments": bpe_segments,
    "tiktoken_encode": _per_word(_byte_rank),
    "tiktoken_encode_text": _whole_texts(tiktoken_spec),
    "tiktoken_registry": tiktoken_registry,
    "unigram_encode": _per_word(_unigram),
    "unigram_encode_text": _whole_texts(unigram_spec),
    "sp_bpe_merges": sp_bpe_merges,
    "sp_bpe_encode": _per_word(_piece_merges),
    "sp_bpe_encode_text": _whole_texts(sp_bpe_spec),
    "sp_normalize_unigram": sp_normalize_unigram,
    "token_to_id": token_to_id,
    "id_to_token": id_to_token,
    "id_offset": id_offset,
    "added_token_split": added_token_split,
}

_TURNS = "turns as (select q.conv_id * 1000 + q.turn k, q.conv_id, q.turn, q.text, a.text answer from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant')"


def _decoded_sql() -> str:
    """The pieces of every document, specials left out, put together again."""
    base = _encoded_sql("").replace("list(wp.ids order by p.pos) filter (wp.ids is not null)", "list(wp.toks order by p.pos) filter (wp.toks is not null)").rstrip()
    spelled = cleaned("replace(coalesce(array_to_string(ids, ' '), ''), ' ##', '')")
    return f"{base} select doc_id, {spelled} as value from enc"


def _tokens_sql() -> str:
    """Every token of every document with its place in the lower-cased text."""
    tiles = _extract("lower(text)", rf"[{_WS}]+|[{_RE2_PUNCT}]|[^{_WS}{_RE2_PUNCT}]+")
    size = "case when tok = '[UNK]' then length(w) when i > 1 then length(tok) - 2 else length(tok) end"
    return f"""with recursive {_VOCAB}, tiles as (select doc_id, unnest(s) w, generate_subscripts(s, 1) t from (select doc_id, {tiles} s from documents)),
placed as (select doc_id, w, t, sum(length(w)) over (partition by doc_id order by t) - length(w) st from tiles),
parts as (select doc_id, w, t, st from placed where not regexp_matches(w, '^[{_WS}]+$')),
seg as (select distinct w from parts), {_GREEDY},
flat as (select w, unnest(toks) tok, unnest(ids) id, generate_subscripts(toks, 1) i from wp),
sized as (select w, tok, id, i, {size} len, sum({size}) over (partition by w order by i) e from flat),
body as (select doc_id, row_number() over (partition by doc_id order by t, i) pos, tok, id, st + e - len a, st + e b from parts join sized using (w))
select doc_id, pos::int pos, tok as token, id::int id, a::int "start", b::int "end" from body
union all select doc_id, 0, '[CLS]', 2, 0, 0 from documents where text is not null
union all select doc_id, (select count(*) from body where body.doc_id = d.doc_id)::int + 1, '[SEP]', 3, 0, 0 from documents d where text is not null"""


def _pair_sql() -> str:
    """Both texts of a turn as rows of one table, encoded together, then put side by side."""
    base = _encoded_sql("", "both", "b")
    ids, types = "flatten([[2], x.ids, [3], y.ids, [3]])", "flatten([[0], list_transform(x.ids, lambda v: 0), [0], list_transform(y.ids, lambda v: 1), [1]])"
    given = f'with recursive {_TURNS}, "both" as (select k * 2 b, text from turns union all select k * 2 + 1, answer from turns),'
    return base.replace("with recursive", given, 1).replace("from both", 'from "both"') + f"select conv_id, turn, len({ids})::bigint n, md5({_TEXT(ids)}) ids_md5, md5({_TEXT(types)}) types_md5 from turns join enc x on x.b = k * 2 join enc y on y.b = k * 2 + 1"


SQL = {
    "wordpiece_word_pieces": f"with recursive {_VOCAB}, seg as (select w from freq), {_GREEDY} select w, array_to_string(toks, ' ') pieces from wp",
    "wordpiece_encode": _encoded_sql(f"select doc_id, len({_WITH})::bigint n, md5({_TEXT(_WITH)}) ids_md5 from enc"),
    "encode_max_tokens": _encoded_sql(f"select doc_id, {_TEXT('ids[1:8]')} ids from enc"),
    "encode_to_ids": _encoded_sql(f"select doc_id, {_TEXT(f'({_WITH})[1:8]')} ids from enc"),
    "count_tokens": _encoded_sql("select doc_id, len(ids)::bigint + 2 n_tokens from enc"),
    "count_tokens_by_group": _encoded_sql("select lang, count(*) docs, sum(len(ids) + 2)::bigint tokens from enc join documents using (doc_id) group by lang"),
    "encode_pair": _pair_sql(),
    "tokens_relation": _tokens_sql(),
    "encode_to_ids_whole": _encoded_sql(f"select doc_id, {_TEXT(_WITH)} ids from enc"),
    "decode_ids_wordpiece": _decoded_sql(),
    "bpe_encode": f"with recursive {_FREQ}, {_PAIRS}, {_MERGED('pairs', 'w', 'mm.l = b.s[i] and mm.r = b.s[i + 1]')}",
    "bpe_segments": _SEGMENTS(gpt2_segments_sql("text")),
    "tiktoken_encode": f"with recursive {_FREQ}, {_PAIRS}, toks as (select l || r t, min(rk) rk from pairs group by 1), {_MERGED('toks', 'w', 'mm.t = b.s[i] || b.s[i + 1]')}",
    "tiktoken_registry": "select * from (values " + ", ".join(f"('{n}', '{e}')" for n, e in [*MODELS.items(), *PREFIXES]) + ") t(name, encoding)",
    "unigram_encode": _VITERBI,
    "sp_bpe_merges": f"with {_PIECE_VOCAB} select id::int id, k::int k, l, r from rules",
    "sp_bpe_encode": f"with recursive {_PIECE_VOCAB}, ranked as (select l, r, row_number() over (order by id, k) rk from rules), {_MERGED('ranked', '''chr(9601) || w''', 'mm.l = b.s[i] and mm.r = b.s[i + 1]')}",
    "sp_normalize_unigram": f"select doc_id, case when length(t) > 0 then replace(' ' || t, ' ', '▁') else t end as value from (select doc_id, trim(regexp_replace(text, '[{_WS}]+', ' ', 'g'), ' ') t from documents)",
    "token_to_id": f"with {_VOCAB} select w as token, id::int id from freq left join vocab on tok = w",
    "id_to_token": f"with {_VOCAB} select p_partkey::int id, tok as token from part left join vocab on id = p_partkey",
    "id_offset": "select p_partkey, case when p_partkey >= 4 then p_partkey + 1 else p_partkey end::bigint as external, (case when (case when p_partkey >= 4 then p_partkey + 1 else p_partkey end) >= 4 then (case when p_partkey >= 4 then p_partkey + 1 else p_partkey end) - 1 else (case when p_partkey >= 4 then p_partkey + 1 else p_partkey end) end)::bigint as internal from part",
    "added_token_split": _SEGMENTS("list_filter(regexp_extract_all(regexp_replace(text, '(then|the|##)', chr(1) || '\\1' || chr(2), 'g'), '\\x01[^\\x02]*\\x02|[^\\x01]+'), lambda x: true)").replace("array_to_string(s, ", "array_to_string(list_transform(s, lambda x: replace(replace(x, chr(1), ''), chr(2), '')), "),
}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return SQL
