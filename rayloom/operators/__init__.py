"""DataFrame operators: images, requests, corpus, jobs, stores, annotations."""
