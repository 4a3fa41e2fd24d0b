"""Capture and point-cloud analytics as Spark jobs: catalogue, telemetry, keyframes, point clouds, alignment and tensor QA."""
