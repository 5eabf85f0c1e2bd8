"""pixelweave: DataFrame operators for large collections of camera frames.

Frames are handled as rows.  ``pixels(session, frame_id, ch, y, x, v)`` is the
long form every operator understands; ``frames(session, frame_id, frame_number,
width, height, channels, ...)`` carries one row of metadata per frame.
Operators are plain functions ``DataFrame -> DataFrame`` that work on many
sessions at once.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# executors get the Python functions themselves, so they need no copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
