"""Inputs of peptide property models, and predictors that run them on Arrow batches.

A predictor takes a table of (modseq, charge) and adds ``rt``, ``ccs`` and ``ms2``; ``library.assemble`` takes any. Models are
ONNX files that executors can read; a worker opens each once. The files' scaling of charge and collision energy belongs
to the model and is a parameter without default.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from peakloom.functions.chemistry import ELEMENTS

#: The model's element vocabulary, in its order; any other symbol takes the last place.
MOD_ELEMENTS = (
    "C", "H", "N", "O", "P", "S", "B", "F", "I", "K", "U", "V", "W", "X", "Y", "Ac", "Ag", "Al", "Am", "Ar", "As", "At", "Au", "Ba", "Be", "Bi", "Bk",
    "Br", "Ca", "Cd", "Ce", "Cf", "Cl", "Cm", "Co", "Cr", "Cs", "Cu", "Dy", "Er", "Es", "Eu", "Fe", "Fm", "Fr", "Ga", "Gd", "Ge", "He", "Hf", "Hg", "Ho",
    "In", "Ir", "Kr", "La", "Li", "Lr", "Lu", "Md", "Mg", "Mn", "Mo", "Na", "Nb", "Nd", "Ne", "Ni", "No", "Np", "Os", "Pa", "Pb", "Pd", "Pm", "Po", "Pr",
    "Pt", "Pu", "Ra", "Rb", "Re", "Rh", "Rn", "Ru", "Sb", "Sc", "Se", "Si", "Sm", "Sn", "Sr", "Ta", "Tb", "Tc", "Te", "Th", "Ti", "Tl", "Tm", "Xe", "Yb",
    "Zn", "Zr", "2H", "13C", "15N", "18O", "?",
)
_AT = {e: i for i, e in enumerate(MOD_ELEMENTS)}
#: Names of the modifications by UniMod number.
UNIMOD = {"1": "Acetyl", "4": "Carbamidomethyl", "21": "Phospho", "35": "Oxidation"}
_PART = re.compile(r"(?:^\.\(UniMod:(\d+)\))?([A-Z])(?:\(UniMod:(\d+)\))?")


@dataclass(frozen=True)
class ModelInputs:
    """Of peptides of one length n: ``residues`` (batch, n + 2) with zero at both ends and A = 1, ``mods`` (batch, n + 2, 109)."""

    residues: np.ndarray
    mods: np.ndarray


def element_index(symbol: str) -> int:
    return _AT.get(symbol, len(MOD_ELEMENTS) - 1)


def parts(modseq: str) -> tuple[str, list[tuple[int, str]]]:
    """The plain sequence and (position, modification): 0 is the N-terminus, residues count from one."""
    found = _PART.findall(modseq)
    if "".join(f".(UniMod:{a})" * bool(a) + r + f"(UniMod:{b})" * bool(b) for a, r, b in found) != modseq:
        raise ValueError(f"not a modified sequence: {modseq}")
    mods = [(0, UNIMOD[found[0][0]])] if found and found[0][0] else []
    return "".join(r for _, r, _ in found), mods + [(i, UNIMOD[b]) for i, (_, _, b) in enumerate(found, 1) if b]


def inputs(modseqs: list[str]) -> ModelInputs:
    """Residue indices come from the plain sequences; a modification adds its element counts at its position."""
    split = [parts(m) for m in modseqs]
    lengths = {len(s) for s, _ in split}
    if len(lengths) != 1:
        raise ValueError("a batch holds peptides of one length")
    n = lengths.pop()
    residues, mods = np.zeros((len(split), n + 2), np.int64), np.zeros((len(split), n + 2, len(MOD_ELEMENTS)), np.float32)
    for k, (sequence, placed) in enumerate(split):
        residues[k, 1:-1] = np.frombuffer(sequence.encode(), np.uint8) - 64
        for position, name in placed:
            for symbol, count in ELEMENTS[name].items():
                mods[k, position, element_index(symbol)] += count
    return ModelInputs(residues, mods)


Model = Callable[[ModelInputs, np.ndarray], tuple[np.ndarray, np.ndarray, list[np.ndarray]]]


def batched(forms: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """``forms`` with the predictions of a model that ``load`` opens once in each worker: it gets peptides of one length and
    their charges, and gives retention times, collision cross sections and flat fragment intensities."""
    names = forms.columns
    seq, charge = names.index("modseq"), names.index("charge")
    schema = T.StructType([*forms.schema.fields, T.StructField("rt", T.DoubleType()), T.StructField("ccs", T.DoubleType()), T.StructField("ms2", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load()
            modseqs, charges = batch.column(seq).to_pylist(), np.array(batch.column(charge).to_pylist(), np.float32)
            by_length: dict[int, list[int]] = {}
            for i, m in enumerate(modseqs):
                by_length.setdefault(len(parts(m)[0]), []).append(i)
            rt, ccs, ms2 = np.zeros(len(modseqs)), np.zeros(len(modseqs)), [None] * len(modseqs)
            for n, rows in by_length.items():
                found = model(inputs([modseqs[i] for i in rows]), charges[rows])
                rt[rows], ccs[rows] = found[0], found[1]
                for i, flat in zip(rows, found[2], strict=True):
                    if len(flat) != (n - 1) * 8:
                        raise ValueError(f"{len(flat)} intensities for {n} residues")
                    ms2[i] = np.asarray(flat, np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rt), pa.array(ccs), pa.array(ms2, pa.list_(pa.float32()))], names=[*names, "rt", "ccs", "ms2"])

    return forms.mapInArrow(run, schema)


def onnx_predictor(rt_path: str, ccs_path: str, ms2_path: str, charge_scale: float, energy_scale: float, energy: float = 30.0, instrument: int = 0, floor: float = 1e-4) -> Callable[[DataFrame], DataFrame]:
    """A predictor of three ONNX models. Intensities under ``floor`` of the strongest are zero, as is the first b ion."""

    def load() -> Model:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        rt, ccs, ms2 = (onnxruntime.InferenceSession(p, options) for p in (rt_path, ccs_path, ms2_path))

        def feed(session, values):
            return session.run(None, {given.name: v for given, v in zip(session.get_inputs(), values, strict=False)})[0]

        def predict(x: ModelInputs, charges: np.ndarray):
            z = (charges * charge_scale)[:, None]
            flat = feed(ms2, (x.residues, x.mods, z, np.full_like(z, energy * energy_scale), np.full(len(z), instrument, np.int64))).reshape(len(z), -1)
            flat = flat / np.maximum(flat.max(axis=1, keepdims=True), 1e-12)
            flat[flat < floor] = 0
            flat[:, 0] = 0
            return feed(rt, (x.residues, x.mods)).ravel(), feed(ccs, (x.residues, x.mods, z)).ravel(), list(flat)

        return predict

    return lambda forms: batched(forms, load)
