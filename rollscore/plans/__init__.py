"""Join plans that hold under skew, and the public jobs."""
