"""The contract of sidecars and of the slides table, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

# The words that a field may hold.
SPECIES = ("mouse", "pig", "human")
STAINS = ("he", "cyp2e1")
MODALITIES = ("brightfield", "fluorescence")

_TEXT, _WHOLE = T.StringType(), T.LongType()

#: The slides table. Its key is (directory, file, scene); only original_name may be null.
SLIDES = T.StructType(
    [
        T.StructField("file", _TEXT, False),
        T.StructField("species", _TEXT, False),
        T.StructField("substance", _TEXT, False),
        T.StructField("dose_mg_per_kg", _WHOLE, False),
        T.StructField("animal_id", _TEXT, False),
        T.StructField("stain", _TEXT, False),
        T.StructField("modality", _TEXT, False),
        T.StructField("serial_block", _TEXT, False),
        T.StructField("original_name", _TEXT, True),
        T.StructField("directory", _TEXT, False),
        T.StructField("scene", _WHOLE, False),
    ]
)
COLUMNS = SLIDES.names
KEY = ["directory", "file", "scene"]
ENUMS = {"species": SPECIES, "stain": STAINS, "modality": MODALITIES}
WHOLE = ("dose_mg_per_kg", "scene")
OPTIONAL = ("original_name", "directory", "scene")  # a sidecar may lack these

#: Rows of sidecar texts.
SIDECARS = "directory string, sidecar_path string, text string"
