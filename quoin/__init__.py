"""Contract analytics over keyed texts and paginated documents, on Spark."""
