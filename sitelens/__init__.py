"""sitelens: web-crawl quality analytics and corpus processing as Spark jobs."""
