"""Source-code security analytics over corpora of files and crawled responses, on Spark."""
