"""The scan: detectors that read artifacts, and the frame of findings and diagnostics they fill."""
