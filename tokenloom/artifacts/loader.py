"""Loading of tokenizers: which files count, in which order, and how their settings combine.
All of it runs on the driver; artifacts are small files."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass, replace
from pathlib import Path
from urllib.parse import urlparse

from tokenloom.artifacts import piece_model as pm
from tokenloom.artifacts import registry
from tokenloom.kernels.bpe import Bpe
from tokenloom.kernels.byte_rank import ByteRank
from tokenloom.kernels.piece_models import PieceMerges, Unigram
from tokenloom.kernels.wordpiece import WordPiece
from tokenloom.spec import AddedToken, BpeOptions, Padding, TokenizerNotSupported, TokenizerSpec, Truncation, WordPieceOptions

#: Names under which piece models lie beside other files, and what is fetched from afar, in order.
PIECE_FILES = ("sentencepiece.bpe.model", "tokenizer.model", "spiece.model")
REMOTE_FILES = ("tokenizer.json", "tokenizer_config.json", *PIECE_FILES, "vocab.txt", "vocab.json", "merges.txt", "special_tokens_map.json", "added_tokens.json")
SPECIAL_NAMES = ("bos_token", "eos_token", "pad_token", "cls_token", "sep_token", "mask_token", "unk_token")


@dataclass(frozen=True)
class LoadOptions:
    fallback_to_other_variants: bool = True
    cache_dir: str | None = None
    fetch: object = None  # fetch(model_id, revision, file name) -> bytes | None
    parse_json: object = json.loads  # parse_json(bytes) -> dict


# --- readers -------------------------------------------------------------------------------


def read_bytes(source) -> bytes:
    """A path, bytes, or a file object."""
    if isinstance(source, (bytes, bytearray)):
        return bytes(source)
    return source.read() if hasattr(source, "read") else Path(source).read_bytes()


def read_vocab_text(source) -> dict[str, int]:
    """One token a line, the line number its id; a repeated token has its last line's."""
    return {line.rstrip(): i for i, line in enumerate(_lines(source))}


def _lines(source) -> list[str]:
    """Lines end at carriage returns and line feeds alone, not at other breaks of Unicode."""
    lines = re.split("\r\n|\n|\r", read_bytes(source).decode())
    return lines if lines[-1] else lines[:-1]


def read_merges(source) -> list[tuple[str, str]]:
    """Two parts a line; blank lines and comments don't count."""
    kept = [line.strip() for line in read_bytes(source).decode().split("\n")]
    parts = [line.split(" ") for line in kept if line and not line.startswith("#")]
    return [(p[0], p[1]) for p in parts if len(p) > 1]


def read_ranks(source) -> dict[bytes, int]:
    """Lines of base64 and rank, or of base64 alone with the line number as rank."""
    out: dict[bytes, int] = {}
    for line in _lines(source):
        if not line.strip() or line.startswith("Capacity: "):
            continue
        parts = line.split()
        try:
            out[base64.b64decode(parts[0], validate=True)] = int(parts[1]) if len(parts) > 1 else len(out)
        except ValueError as e:
            raise ValueError(f"malformed line {line!r}") from e
    return out


# --- tokenizer.json ------------------------------------------------------------------------


def infer_backend(root: dict) -> str:
    """The backend that a tokenizer.json describes."""
    model = root.get("model") or {}
    named = {"wordpiece": "WordPiece", "bpe": "Bpe", "unigram": "SentencePieceUnigram", "sentencepiecebpe": "SentencePieceBpe", "sentencepiece_bpe": "SentencePieceBpe"}
    kind = str(model.get("type") or "").lower()
    if kind.strip():
        return named.get(kind, "Unknown")
    prefix = model.get("continuing_subword_prefix")
    if prefix is not None:
        return "WordPiece" if "merges" not in model or model["merges"] == [] or prefix == "##" else "Bpe"
    return "Bpe" if "merges" in model else "SentencePieceUnigram" if "scores" in model else "Unknown"


def parse_added_tokens(root: dict) -> tuple[AddedToken, ...]:
    flag = lambda t, k, d=False: bool(t.get(k, d))
    return tuple(AddedToken(int(t["id"]), t["content"], flag(t, "single_word"), flag(t, "lstrip"), flag(t, "rstrip"), flag(t, "normalized", not t.get("special", False)), flag(t, "special")) for t in root.get("added_tokens") or [])


def parse_truncation(root: dict) -> Truncation | None:
    t = root.get("truncation")
    return Truncation(int(t["max_length"]), str(t.get("strategy") or "longest_first"), str(t.get("direction") or "right").lower(), int(t.get("stride") or 0)) if t else None


def parse_padding(root: dict) -> Padding | None:
    p = root.get("padding")
    if not p:
        return None
    strategy = p.get("strategy")
    length = p.get("length")
    if isinstance(strategy, dict):
        name, value = next(iter(strategy.items()))
        strategy, length = name, value if name == "Fixed" else length
    return Padding(strategy, str(p.get("direction") or "right").lower(), length, int(p.get("pad_id") or 0), int(p.get("pad_type_id") or 0), p.get("pad_token") or "[PAD]", int(p.get("pad_to_multiple_of") or 0))


def _text(value) -> str | None:
    return value.get("content") if isinstance(value, dict) else value


def wordpiece_options(root: dict, config: dict | None) -> WordPieceOptions:
    """Settings from the weakest source to the strongest: the model, the root, normalizer,
    pre-tokenizer, decoder, post-processor, tokenizer_config.json."""
    model, o = root.get("model") or {}, WordPieceOptions()
    said = lambda source, **names: {k: v for k, n in names.items() if (v := _text(source.get(n))) is not None}
    o = replace(o, **said(model, unk_token="unk_token", prefix="continuing_subword_prefix", max_input_chars="max_input_chars_per_word"))
    tokens = dict(unk_token="unk_token", cls_token="cls_token", sep_token="sep_token", pad_token="pad_token", mask_token="mask_token")
    o = replace(o, **said(root, clean_up="clean_up_tokenization_spaces", **tokens))
    normalizer = root.get("normalizer") or {}
    kind = str(normalizer.get("type", "")).lower()
    if kind == "bert":
        o = replace(o, lowercase=bool(normalizer.get("lowercase", o.lowercase)))
    elif kind == "lowercase":
        o = replace(o, lowercase=True)
    if pre := root.get("pre_tokenizer"):
        o = replace(o, basic_tokenization=str(pre.get("type", "")).lower() in ("bertpretokenizer", "bert"))
    decoder = root.get("decoder") or {}
    o = replace(o, **said(decoder, prefix="prefix", clean_up="cleanup"))
    for name, field in (("cls", "cls_token"), ("sep", "sep_token")):
        pair = (root.get("post_processor") or {}).get(name)
        if isinstance(pair, list) and pair:
            o = replace(o, **{field: next(x for x in pair if isinstance(x, str))})
    if config:
        o = replace(o, **said(config, lowercase="do_lower_case", basic_tokenization="do_basic_tokenize", clean_up="clean_up_tokenization_spaces", **tokens))
    return o


def _types(component: dict | None) -> list[str]:
    """The types of a component and of all within it."""
    if not component:
        return []
    inner = component.get("pretokenizers") or component.get("decoders") or component.get("normalizers") or []
    return [str(component.get("type", "")).lower(), *(t for c in inner for t in _types(c))]


def bpe_from_json(root: dict) -> Bpe:
    model, pre = root.get("model") or {}, root.get("pre_tokenizer")
    pairs, ranks = [], []
    for rank, m in enumerate(model.get("merges") or []):
        parts = m.split(" ") if isinstance(m, str) else m
        if len(parts) >= 2:
            pairs.append((parts[0], parts[1]))
            ranks.append(rank)
    outer = pre if pre and str(pre.get("type", "")).lower() == "bytelevel" else {}
    options = BpeOptions(model.get("unk_token"), model.get("continuing_subword_prefix") or "", model.get("end_of_word_suffix") or "", "bytelevel" in _types(pre) + _types(root.get("decoder")), bool(outer.get("add_prefix_space", False)), outer.get("use_regex", True) is not False, pre is not None)
    return Bpe(model.get("vocab") or {}, pairs, options, ranks)


def _config_specials(vocab: dict[str, int], *sources: dict | None) -> list[AddedToken]:
    """Special tokens named in settings, where the vocabulary has them."""
    named = [t for s in sources if s for t in [*(_text(s.get(n)) for n in SPECIAL_NAMES), *map(_text, s.get("additional_special_tokens") or [])] if t]
    return [AddedToken(vocab[t], t, normalized=False, special=True) for t in dict.fromkeys(named) if t in vocab]


def post_specials(component: dict | None) -> list[AddedToken]:
    """The special tokens that a post-processor and all its parts put in."""
    c = component or {}
    kind = str(c.get("type", "")).lower()
    defaults = {"bertprocessing": (("cls", "[CLS]", 101), ("sep", "[SEP]", 102)), "robertaprocessing": (("cls", "<s>", 0), ("sep", "</s>", 2))}
    found: list[tuple[str, int]] = []
    for name, text, i in defaults.get(kind, ()):
        said = c.get(name) if isinstance(c.get(name), list) else []
        found.append((next((x for x in said if isinstance(x, str)), text), next((x for x in said if isinstance(x, int)), i)))
    if kind == "templateprocessing" and isinstance(c.get("single"), list):
        found += [(t, i) for one in (c.get("special_tokens") or {}).values() for t, i in zip(one.get("tokens") or [], one.get("ids") or [], strict=False)]
    inner = [t for part in c.get("processors") or [] for t in post_specials(part)] if kind == "sequence" else []
    return [*(AddedToken(int(i), t, normalized=False, special=True) for t, i in found), *inner]


def _merged_tokens(*groups) -> tuple[AddedToken, ...]:
    """Tokens of the same id become one that has the text of the first and the flags of all."""
    out: dict[int, AddedToken] = {}
    for t in (t for g in groups for t in g):
        old = out.get(t.id)
        out[t.id] = t if old is None else AddedToken(old.id, old.content, *(getattr(old, f) or getattr(t, f) for f in ("single_word", "lstrip", "rstrip", "normalized", "special")))
    return tuple(out.values())


def from_tokenizer_json(source, model=None, config=None) -> TokenizerSpec:
    """A spec from tokenizer.json (a path, or its bytes, or a file); piece models need their
    model file beside it, or given."""
    if isinstance(source, (str, Path)) and Path(source).name == "tokenizer.json":
        return from_local(Path(source).parent)
    return _from_json(json.loads(read_bytes(source)), read_bytes(model) if model is not None else None, json.loads(read_bytes(config)) if config is not None else None)


def _from_json(root: dict, model: bytes | None, config: dict | None, hint: str = "") -> TokenizerSpec:
    backend = infer_backend(root)
    if model is not None and pm.parse_piece_model(model).model_type == pm.BPE and backend in ("Bpe", "Unknown"):
        backend = "SentencePieceBpe"
    if backend == "Unknown":
        kind = str((config or {}).get("model_type") or "").lower()
        backend = "SentencePieceBpe" if ".bpe." in hint or "bpe" in kind else "SentencePieceUnigram" if model is not None else "Unknown"
    parts = dict(normalizer=root.get("normalizer"), pre_tokenizer=root.get("pre_tokenizer"), post_processor=root.get("post_processor"), decoder=root.get("decoder"))
    added = parse_added_tokens(root)
    if backend == "WordPiece":
        vocab = (root.get("model") or {}).get("vocab") or {}
        kernel = WordPiece(vocab, wordpiece_options(root, config))
        return TokenizerSpec(backend, kernel, special_ids={t.content: t.id for t in _config_specials(vocab, root, config)}, **parts)
    if backend == "Bpe":
        kernel = bpe_from_json(root)
        tokens = _merged_tokens(added, _config_specials(kernel.vocab, root, config), post_specials(root.get("post_processor")))
        return TokenizerSpec(backend, kernel, added_tokens=tokens, special_ids={t.content: t.id for t in tokens if t.special}, **parts)
    if backend.startswith("SentencePiece") and model is not None:
        spec = piece_spec(model, id_offset=_moved_ids("", config), split=root.get("pre_tokenizer"))
        return spec.with_(added_tokens=_merged_tokens(added, post_specials(root.get("post_processor"))), truncation=parse_truncation(root), padding=parse_padding(root), **parts)
    raise TokenizerNotSupported(f"a {backend} tokenizer can't be loaded from tokenizer.json alone", backend)


# --- other artifacts -----------------------------------------------------------------------


def _moved_ids(directory: str, config: dict | None) -> bool:
    name = directory.lower()
    return "xlm-roberta" in name or "xlm_roberta" in name or "xlm" in str((config or {}).get("model_type") or "").lower()


def piece_spec(source, id_offset: bool = False, add_dummy_prefix: bool = True, split: dict | None = None) -> TokenizerSpec:
    """A spec from a piece model of either type."""
    model = pm.parse_piece_model(read_bytes(source))
    if model.model_type == pm.BPE:
        plain = split and str(split.get("type", "")).lower() == "split" and split.get("behavior") == "MergedWithPrevious" and not split.get("invert") and split.get("pattern") in (" ", {"String": " "})
        return TokenizerSpec("SentencePieceBpe", PieceMerges(model, id_offset, add_dummy_prefix and not plain))
    if model.model_type != pm.UNIGRAM:
        raise TokenizerNotSupported("only unigram and BPE piece models are supported")
    return TokenizerSpec("SentencePieceUnigram", Unigram(model, id_offset))


def wordpiece(source, options: WordPieceOptions | None = None) -> TokenizerSpec:
    return TokenizerSpec("WordPiece", WordPiece(read_vocab_text(source), options))


def bpe(vocab, merges, options: BpeOptions | None = None) -> TokenizerSpec:
    return TokenizerSpec("Bpe", Bpe(json.loads(read_bytes(vocab)), read_merges(merges), options))


def tiktoken(source, encoding: str | None = None) -> TokenizerSpec:
    """From ranks; the encoding's name is the file's where none is given."""
    name = encoding or (Path(source).stem if isinstance(source, (str, Path)) else None)
    _, pattern, specials = registry.resolve(name)
    return TokenizerSpec("Tiktoken", ByteRank(read_ranks(source), pattern, specials), special_ids=specials)


def bpe_options(config: dict | None) -> BpeOptions:
    """Options of vocab.json and merges.txt from tokenizer_config.json."""
    config = config or {}
    kind = str(config.get("model_type") or "").lower()
    by_bytes = any(k in kind for k in ("gpt", "roberta", "byte"))
    prefix, split = config.get("add_prefix_space"), config.get("use_regex")
    return BpeOptions(_text(config.get("unk_token")), config.get("continuing_subword_prefix") or "", config.get("end_of_word_suffix") or "", by_bytes, bool(prefix) if prefix is not None else "roberta" in kind, True if split is None else bool(split))


# --- discovery -----------------------------------------------------------------------------


def discover(directory) -> list[tuple[str, str]]:
    """(variant, file) of a folder, in the order in which they are tried."""
    d = Path(directory)
    names = sorted(p.name for p in d.iterdir()) if d.is_dir() else []
    found = [("tokenizer.json", "tokenizer.json")] if "tokenizer.json" in names else []
    found += [("piece model", n) for n in names if n.endswith(".model")][:1]
    found += [("vocab.txt", "vocab.txt")] if "vocab.txt" in names else []
    found += [("vocab.json", "vocab.json")] if {"vocab.json", "merges.txt"} <= {*names} else []
    return found + [("tiktoken", n) for n in names if n.endswith(".tiktoken")][:1]


def from_local(directory, options: LoadOptions | None = None) -> TokenizerSpec:
    """The first variant of a folder that loads; a tokenizer.json that fails is passed over
    only if the options allow it."""
    o, d = options or LoadOptions(), Path(directory)
    try:
        config = o.parse_json((d / "tokenizer_config.json").read_bytes())
    except (OSError, ValueError):
        config = None
    refused: TokenizerNotSupported | None = None
    for variant, name in discover(d):
        path = d / name
        if variant == "tokenizer.json":
            try:
                model = next((p for n in PIECE_FILES if (p := d / n).exists()), next(iter(sorted(d.glob("*.model"))), None))
                spec = _from_json(o.parse_json(path.read_bytes()), model.read_bytes() if model else None, config, model.name if model else "")
                if _moved_ids(d.name, config) and spec.backend.startswith("SentencePiece"):
                    spec.model.id_offset = True
                return spec
            except Exception as e:
                if not o.fallback_to_other_variants:
                    raise
                refused = e if isinstance(e, TokenizerNotSupported) else refused
        elif variant == "piece model":
            return piece_spec(path, _moved_ids(d.name, config))
        elif variant == "vocab.txt":
            return wordpiece(path, wordpiece_options({}, config))
        elif variant == "vocab.json":
            return bpe(path, d / "merges.txt", bpe_options(config))
        else:
            return tiktoken(path)
    if refused:
        raise refused
    raise FileNotFoundError(f"no tokenizer files in {directory}")


def split_model_id(name: str, revision: str | None = None) -> tuple[str, str]:
    """Model id and revision; the revision may follow an @."""
    model, _, own = name.partition("@")
    return model, revision or own or "main"


def from_pretrained(name: str, revision: str | None = None, options: LoadOptions | None = None) -> TokenizerSpec:
    """From the cache folder; what isn't there comes from ``options.fetch``, if given."""
    o = options or LoadOptions()
    model, revision = split_model_id(name, revision)
    root = Path(o.cache_dir or Path.home() / ".cache" / "tokenloom" / "hub") / f"{model.replace('/', '--')}--{revision}"
    pieces_done = False
    for file in REMOTE_FILES:
        path = root / file
        if file in PIECE_FILES and pieces_done:
            continue
        if not path.exists() and callable(o.fetch):
            data = o.fetch(model, revision, file)
            if data is not None:
                root.mkdir(parents=True, exist_ok=True)
                path.write_bytes(data)
        pieces_done |= file in PIECE_FILES and path.exists()
    if not discover(root):
        raise FileNotFoundError(f"{model} isn't in the cache {root}, and nothing was fetched")
    return from_local(root, o)


def load(where: str, options: LoadOptions | None = None) -> TokenizerSpec:
    """A folder, a model's address (its first two path parts), or a model id."""
    if Path(where).is_dir():
        return from_local(where, options)
    url = urlparse(where)
    if url.scheme in ("http", "https") and re.fullmatch(r"(www\.)?huggingface\.co", url.netloc):
        return from_pretrained("/".join([p for p in url.path.split("/") if p][:2]), None, options)
    return from_pretrained(where, None, options)


def create(model: object) -> TokenizerSpec:
    """A spec around a model of one of the engine's own classes."""
    backends = {WordPiece: "WordPiece", Bpe: "Bpe", ByteRank: "Tiktoken", PieceMerges: "SentencePieceBpe", Unigram: "SentencePieceUnigram"}
    if type(model) not in backends:
        raise TokenizerNotSupported(f"{type(model).__name__} isn't a model of this engine")
    return TokenizerSpec(backends[type(model)], model)
