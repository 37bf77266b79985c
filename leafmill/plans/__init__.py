"""leafmill.plans"""
