"""encephalake: multichannel time-series (EEG) analytics as Spark DataFrames.

Recordings, markers and session metadata are plain tables.  Operators are
``DataFrame -> DataFrame`` functions; Catalyst plans the relational work and
Arrow-batched numpy kernels run inside tasks for FFTs and small matrices.
"""

__version__ = "0.1.0"
