"""What runs the two networks: any object with these two methods, made in each Python worker."""

from __future__ import annotations

from typing import Protocol

import numpy as np


class TensorRuntime(Protocol):
    def detect(self, tensor: np.ndarray) -> np.ndarray:
        """1 x 3 x H x W to an H x W probability map."""

    def recognise(self, batch: np.ndarray) -> np.ndarray:
        """N x 3 x 48 x W to N x steps x classes probabilities."""


class OnnxRuntime:
    """The two networks from local ONNX files: CPU only, in sequence, deterministic."""

    def __init__(self, detector: str, recogniser: str, threads: int = 1):
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.execution_mode = ort.ExecutionMode.ORT_SEQUENTIAL
        options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
        options.intra_op_num_threads = options.inter_op_num_threads = threads
        options.use_deterministic_compute = True
        options.enable_mem_pattern = False
        options.add_session_config_entry("session.intra_op.allow_spinning", "0")
        self.sessions = [ort.InferenceSession(path, options, providers=["CPUExecutionProvider"]) for path in (detector, recogniser)]

    def _run(self, k: int, tensor: np.ndarray) -> np.ndarray:
        session = self.sessions[k]
        return session.run(None, {session.get_inputs()[0].name: tensor})[0]

    def detect(self, tensor: np.ndarray) -> np.ndarray:
        return self._run(0, tensor)[0, 0]

    def recognise(self, batch: np.ndarray) -> np.ndarray:
        return self._run(1, batch)
