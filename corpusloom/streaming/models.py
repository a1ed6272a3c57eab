"""Sequence-to-sequence models as translators, and what can go wrong when one is loaded.

The libraries a model needs are imported where it is loaded, on the executors; this module needs none of them.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable
from pathlib import Path
from types import ModuleType
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession

from corpusloom.session import ship

# How hubs and networks word their refusals, in lower case.
ACCESS_ERRORS = ("gated repo", "401 client error", "403 client error", "not in the authorized list", "access to model", "please log in")
NETWORK_ERRORS = (
    "nodename nor servname provided",
    "temporary failure in name resolution",
    "name or service not known",
    "failed to establish a new connection",
    "connection error",
    "cannot send a request, as the client has been closed",
    "offline mode",
)
DEVICES = ("auto", "cpu", "cuda")
DTYPES = ("auto", "float32", "float16", "bfloat16")


def _says(error: BaseException | str, phrases: tuple[str, ...]) -> bool:
    text = str(error).lower()
    return any(p in text for p in phrases)


def is_access_error(error: BaseException | str) -> bool:
    """Whether a model was refused: gated, or not logged in."""
    return _says(error, ACCESS_ERRORS)


def is_network_error(error: BaseException | str) -> bool:
    """Whether the hub couldn't be reached."""
    return _says(error, NETWORK_ERRORS)


def hub_cache() -> Path:
    home = os.environ.get("HF_HOME")
    return Path(os.environ.get("HF_HUB_CACHE") or (Path(home) if home else Path.home() / ".cache" / "huggingface") / "hub")


def local_source(name: str, cache: Path | None = None) -> str:
    """Where a model is on this machine: ``name`` if that is a path, else its newest snapshot in the cache; else the name."""
    if Path(name).exists():
        return name
    folder = (cache or hub_cache()) / f"models--{name.replace('/', '--')}" / "snapshots"
    found = [p for p in folder.iterdir() if p.is_dir()] if folder.is_dir() else []
    return str(max(found, key=lambda p: p.stat().st_mtime)) if found else name


def library(name: str, hint: str = "") -> ModuleType:
    """A library that the environment has to provide; its absence is told with what to do."""
    try:
        return importlib.import_module(name)
    except ImportError as error:
        raise ImportError(f"this model needs the library {name}" + (f": {hint}" if hint else "")) from error


def device_of(torch: Any, wanted: str) -> str:
    if wanted not in DEVICES:
        raise ValueError(f"device is one of {', '.join(DEVICES)}")
    if wanted == "cuda" and not torch.cuda.is_available():
        raise OSError("a CUDA device was asked for and there is none")
    return "cuda" if wanted != "cpu" and torch.cuda.is_available() else "cpu"


def dtype_of(torch: Any, wanted: str, device: str) -> Any:
    """Half precision on a GPU and full precision elsewhere, unless one is named."""
    if wanted not in DTYPES:
        raise ValueError(f"dtype is one of {', '.join(DTYPES)}")
    return getattr(torch, wanted if wanted != "auto" else "float16" if device == "cuda" else "float32")


class Seq2SeqTranslator:
    """A pretrained encoder-decoder as a translator.

    processor: "module:name" of what makes the object that prepares sentences and finishes decoded ones
    (preprocess_batch, postprocess_batch); none for models that take plain text. ``translate`` gives one text a
    sentence; no sentences give none.
    """

    def __init__(self, name: str, *, device: str = "auto", dtype: str = "auto", max_length: int = 256, num_beams: int = 5, processor: str | None = None):
        self.torch, library_ = library("torch"), library("transformers")
        self.device = device_of(self.torch, device)
        self.max_length, self.num_beams = max_length, num_beams
        source = local_source(name)
        self.tokenizer = self._first(lambda **o: library_.AutoTokenizer.from_pretrained(source, trust_remote_code=True, **o), {}, {"local_files_only": True})
        kind = {"torch_dtype": dtype_of(self.torch, dtype, self.device), "trust_remote_code": True}
        fast = {"attn_implementation": "flash_attention_2"} if self.device == "cuda" else {}
        make = lambda **o: library_.AutoModelForSeq2SeqLM.from_pretrained(source, **kind, **o).to(self.device)
        self.model = self._first(make, fast, {"local_files_only": True})
        self.processor = None
        if processor:
            module, _, attribute = processor.partition(":")
            self.processor = getattr(library(module), attribute)(inference=True)

    @staticmethod
    def _first(make: Callable[..., Any], options: dict[str, Any], offline: dict[str, Any]) -> Any:
        """Made with ``options``; without them where they aren't to be had; from local files where there is no network."""
        try:
            return make(**options)
        except Exception as error:  # noqa: BLE001  each library has its own; others are raised again
            if is_network_error(error):
                return make(**offline)
            if options and any(str(v) in str(error) for v in options.values()):
                return make()
            raise

    def translate(self, sentences: list[str], source: str, target: str) -> list[str]:
        if not sentences:
            return []
        batch = self.processor.preprocess_batch(sentences, src_lang=source, tgt_lang=target) if self.processor else sentences
        inputs = self.tokenizer(batch, truncation=True, padding="longest", return_tensors="pt", return_attention_mask=True).to(self.device)
        with self.torch.no_grad():
            made = self.model.generate(**inputs, use_cache=False, min_length=0, max_length=self.max_length, num_beams=self.num_beams, num_return_sequences=1)
        texts = self.tokenizer.batch_decode(made, skip_special_tokens=self.processor is None, clean_up_tokenization_spaces=True)
        return list(self.processor.postprocess_batch(texts, lang=target)) if self.processor else texts


def load_error(spark: SparkSession, load: Callable[[], Any]) -> str | None:
    """What an executor says when it loads a model; None if it can. Asked once before a run, so that all its
    tasks agree on whether there is a verifier."""
    ship(spark)

    def attempt(frames):
        for _ in frames:
            try:
                load()
                said = None
            except Exception as error:  # noqa: BLE001  told to the driver, which decides
                said = f"{type(error).__name__}: {error}"
            yield pd.DataFrame({"said": [said]}, dtype=object)

    return spark.range(0, 1, 1, 1).mapInPandas(attempt, "said string").first().said


def usable_verifier(spark: SparkSession, load: Callable[[], Any], *, fallback: bool) -> bool:
    """False if the model of the way back is refused and the run may go on without; any other failure is raised."""
    said = load_error(spark, load)
    if said is None:
        return True
    if fallback and is_access_error(said):
        print(f"The verification model can't be loaded; going on without back-translation. It says: {said}")
        return False
    raise RuntimeError(f"the verification model can't be loaded: {said}")
