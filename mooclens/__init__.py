"""mooclens: click-stream features, score calibration, evaluation and
blending expressed as Spark DataFrame jobs.

Every public function takes and returns DataFrames; nothing collects rows
to the driver except small, bounded results (model weights, AUC tables,
bucket bounds whose size is checked).
"""

__version__ = "0.1.0"
