"""Daily station risk analytics as Spark jobs.

``functions``  column expressions (no data access)
``sources``    table, CSV and model-metadata readers and writers
``operators``  DataFrame -> DataFrame building blocks
``models``     Spark ML fits, calibration and scoring
``plans``      whole jobs: data-set build, daily scoring, model evaluation
"""
