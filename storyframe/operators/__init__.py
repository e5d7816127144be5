"""Operators over DataFrames of scripts, transcripts, detections, crops and labels."""
